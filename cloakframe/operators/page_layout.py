"""Lines and paragraphs of pages from words with boxes, and edits of lines as spans.

Words come as a table, one row per word, from whatever reads page files:
(doc_id, page, x0, top, x1, bottom, chars: array of (text, x0, top, x1, bottom, size)); coordinates grow to the
right and downwards.  A page is small, so each is worked out by itself in one Arrow group.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shapes of rows, lines and paragraphs, and what ligature glyphs stand for.
ROW_OVERLAP = 0.5  # of the smaller height
LINE_GAP = 1.0  # in sizes of the larger neighbour
PARAGRAPH_GAP = (-0.2, 0.8)  # in heights of the taller line
PARAGRAPH_SIZES = 0.2  # of the larger size
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
DIFF_GAP = 3

LINES = (
    "doc_id string, page int, seg_ord int, segment_id string, text string, block string, join_before string, size double, "
    "x0 double, top double, x1 double, bottom double, char_boxes array<struct<x0:double,top:double,x1:double,bottom:double>>"
)


def _size(word: dict) -> float:
    """The median size of a word's characters, or its height."""
    known = [c["size"] for c in word["chars"] if c["size"] and c["size"] > 0]
    return float(np.median(known)) if known else word["bottom"] - word["top"]


def row_numbers(tops: np.ndarray, bottoms: np.ndarray) -> np.ndarray:
    """The visual row of each word, for words from top to bottom; a row reaches as far as its words."""

    def place(row: tuple[int, float, float], word: tuple[float, float]) -> tuple[int, float, float]:
        number, top, bottom = row
        shared = min(bottom, word[1]) - max(top, word[0])
        smaller = max(min(bottom - top, word[1] - word[0]), 0.01)
        if shared / smaller >= ROW_OVERLAP:
            return number, min(top, word[0]), max(bottom, word[1])
        return number + 1, *word

    words = list(zip(tops.tolist(), bottoms.tolist(), strict=True))
    if not words:
        return np.zeros(0, np.int64)
    return np.array([number for number, _, _ in accumulate(words[1:], place, initial=(0, *words[0]))])


def line_numbers(words: list[dict]) -> tuple[list[dict], np.ndarray]:
    """(words in reading order, the line of each): rows from the top, cut where a gap is wider than the type."""
    words = sorted(words, key=lambda w: (w["top"], w["x0"]))
    rows = row_numbers(*(np.array([w[c] for w in words], float) for c in ("top", "bottom")))
    order = np.lexsort((np.array([w["x0"] for w in words], float), rows))
    words, rows = [words[i] for i in order], rows[order]
    sizes = np.array([_size(w) for w in words])
    left, right = (np.array([w[c] for w in words], float) for c in ("x0", "x1"))
    wide = left[1:] - right[:-1] > LINE_GAP * np.maximum(np.maximum(sizes[1:], sizes[:-1]), 1.0)
    return words, np.append(0, np.cumsum(wide | (rows[1:] != rows[:-1]))) if len(words) else rows


def line_text(words: list[dict]) -> tuple[str, list[tuple[float, float, float, float]]]:
    """The text of a line and a box for each of its characters; a ligature's box is shared out evenly."""
    top, bottom = min(w["top"] for w in words), max(w["bottom"] for w in words)
    text, boxes = "", []
    for i, word in enumerate(words):
        if i:
            text += " "
            boxes.append((words[i - 1]["x1"], top, word["x0"], bottom))
        for c in word["chars"]:
            shown = LIGATURES.get(c["text"], c["text"])
            edges = np.linspace(c["x0"], c["x1"], len(shown) + 1).tolist()
            text += shown
            boxes += [(a, c["top"], b, c["bottom"]) for a, b in zip(edges, edges[1:], strict=False)]
    return text, boxes


def paragraph_numbers(boxes: np.ndarray, sizes: np.ndarray) -> list[int]:
    """The paragraph of each line (x0, top, x1, bottom), lines from the top: the first whose last line is in the
    same column, close above and of a similar size; else a new one."""
    last: list[int] = []  # of each paragraph its last line so far
    out = []
    height = boxes[:, 3] - boxes[:, 1]
    for i in range(len(boxes)):
        at = np.array(last, np.int64)
        beside = np.minimum(boxes[i, 2], boxes[at, 2]) - np.maximum(boxes[i, 0], boxes[at, 0]) > 0
        gap, tall = boxes[i, 1] - boxes[at, 3], np.maximum(height[i], height[at])
        near = (gap >= PARAGRAPH_GAP[0] * tall) & (gap <= PARAGRAPH_GAP[1] * tall)
        alike = np.abs(sizes[i] - sizes[at]) <= PARAGRAPH_SIZES * np.maximum(sizes[i], sizes[at])
        fits = np.flatnonzero(beside & near & alike)
        if len(fits):
            out.append(int(fits[0]))
            last[out[-1]] = i
        else:
            out.append(len(last))
            last.append(i)
    return out


def page_lines(words: list[dict]) -> Iterator[dict]:
    """The lines of a page that hold more than blanks, with their paragraph."""
    ordered, numbers = line_numbers(words)
    lines = []
    for _, group in groupby(zip(numbers.tolist(), ordered, strict=True), key=lambda x: x[0]):
        own = [w for _, w in group]
        text, boxes = line_text(own)
        if text.strip():
            box = (min(w["x0"] for w in own), min(w["top"] for w in own), max(w["x1"] for w in own), max(w["bottom"] for w in own))
            lines.append({"text": text, "char_boxes": boxes, "box": box, "size": round(float(np.median([_size(w) for w in own])), 2)})
    if lines:
        for line, block in zip(lines, paragraph_numbers(np.array([x["box"] for x in lines], float), np.array([x["size"] for x in lines])), strict=True):
            yield line | {"block": block}


def read_lines(words: DataFrame) -> DataFrame:
    """Segments (one per line, joined into paragraphs by a space) with their boxes, from a table of words.

    Words without characters and pages without words give nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        page = int(pdf["page"].iloc[0])
        rows = [{**w, "chars": list(w["chars"]) if w["chars"] is not None else []} for w in pdf.to_dict("records")]
        out, seen = [], set()
        for i, line in enumerate(page_lines([w for w in rows if w["chars"]])):
            box = line["box"]
            boxes = [{"x0": a, "top": b, "x1": c, "bottom": d} for a, b, c, d in line["char_boxes"]]
            out.append((str(pdf["doc_id"].iloc[0]), page, i, f"page{page}/line{i}", line["text"], f"page{page}/para{line['block']}", " " if line["block"] in seen else "", line["size"], *box, boxes))
            seen.add(line["block"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    each = words.groupBy("doc_id", "page").applyInPandas(run, LINES)
    # line numbers are the page's; of a document, pages come first
    order = (F.col("page").cast("long") * (1 << 20) + F.col("seg_ord")).cast("int")
    return each.withColumn("seg_ord", F.when(F.col("page") < (1 << 11), order).otherwise(F.col("seg_ord")))


def _recorded(old: str, replacements: list[dict] | None) -> list[tuple[int, int, str]]:
    """Recorded spans (start, end, text, perhaps original), or none if one doesn't fit the line."""
    spans = [(int(r["start"]), int(r["end"]), str(r["text"])) for r in replacements or []]
    fits = all(0 <= s <= e <= len(old) and r.get("original") in (None, old[s:e]) for (s, e, _), r in zip(spans, replacements or [], strict=True))
    return spans if fits else []


def _differing(old: str, new: str) -> list[tuple[int, int, str]]:
    """The stretches that differ; those with fewer than three equal characters between them are one."""
    parts = [x[1:] for x in SequenceMatcher(a=old, b=new, autojunk=False).get_opcodes() if x[0] != "equal"]
    runs = accumulate((i > 0 and p[0] - parts[i - 1][1] >= DIFF_GAP for i, p in enumerate(parts)))
    groups = [[p for _, p in g] for _, g in groupby(zip(runs, parts, strict=True), key=lambda x: x[0])]
    return [(g[0][0], g[-1][1], new[g[0][2] : g[-1][3]]) for g in groups]


def _spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(spans, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def plan_spans(old: str, new: str, replacements: list[dict] | None = None) -> list[tuple[int, int, str]]:
    """How a line's text becomes another: by the recorded spans, else by what differs, else as a whole.

    Spans that don't give the new text are never used: rather the whole line goes than that an original stays.
    """
    if old == new:
        return []
    spans = _recorded(old, replacements) or _differing(old, new)
    return spans if _spliced(old, spans) == new else [(0, len(old), new)]
