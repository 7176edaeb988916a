"""Chunks, edges, mentions and the span model against plain statements of their rules."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cloakframe.operators import ner, propagate
from cloakframe.operators import span_model as S


def test_chunks_keep_lines_whole_where_they_can():
    rng = random.Random(3)
    for most in (6, 20):
        for _ in range(300):
            text = "".join(rng.choice(["ab", " ", ". ", "\n", "c"]) for _ in range(rng.randrange(60)))
            chunks = ner.chunk(text, most)
            assert all(text[at : at + len(c)] == c and 0 < len(c) <= most for at, c in chunks)
            covered = {i for at, c in chunks for i in range(at, at + len(c))}
            assert {i for i, c in enumerate(text) if c != "\n"} <= covered and sum(len(c) for _, c in chunks) == len(covered)
            for (a, c), (b, _) in zip(chunks, chunks[1:], strict=False):
                # the next chunk begins a line, or a piece of a line longer than a chunk
                line = text[text.rfind("\n", 0, b) + 1 :].split("\n")[0]
                assert text[b - 1] == "\n" or len(line) > most
                # and its first piece wouldn't have fitted
                first = re.match(r"[^\n]*", text[b:])[0]
                if text[b - 1] == "\n" and len(first) <= most:
                    assert b + len(first) - a > most
    assert ner.chunk("x" * 25 + ". " + "y" * 5, 20) == [(0, "x" * 20), (20, "x" * 5 + ". " + "y" * 5)]
    assert ner.chunk("one. two. three four five", 12) == [(0, "one. two. "), (10, "three four f"), (22, "ive")]
    assert ner.chunk("") == [] and ner.chunk("\n\n") == []


def test_edges(spark):
    df = spark.createDataFrame([("(Bob Roy).",), ("  Ann,",), ("St. Ives",), (".Net",), ("...",), ("'\"",)], "t string")
    got = [tuple(r.x) for r in df.select(ner.trim_edges(F.lit(10), F.col("t")).alias("x")).collect()]
    assert got[:4] == [(11, "Bob Roy"), (12, "Ann"), (10, "St. Ives"), (10, ".Net")] and [g[1] for g in got[4:]] == ["", ""]


def _mentions(text, seeds, covered):
    """The rule by patterns and a mask of characters."""
    mask, out = [False] * len(text), []
    for a, b in covered:
        mask[a:b] = [True] * (b - a)
    for s in sorted(seeds, key=lambda s: -len(s["key"])):
        for m in re.finditer(rf"(?<!\w){re.escape(s['key'])}(?!\w)", text, re.IGNORECASE):
            a, b = m.span()
            near = text[max(0, a - 40) : b + 40]
            named = m[0][0].isupper() or m[0].isupper() or near.islower()
            if not any(mask[a:b]) and (" " in s["key"] or m[0] in s["forms"] or named):
                mask[a:b] = [True] * (b - a)
                out.append((a, b, s["entity_type"]))
    return sorted(out)


def test_mentions_equal_patterns_and_mask():
    rng = random.Random(8)
    seeds = [dict(key=k, entity_type=t, score=0.5, forms=f) for k, t, f in [("ann", "P", ["Ann"]), ("ann lee", "P", ["Ann Lee"]), ("lee", "P", ["lee"]), ("lee ann lee", "O", []), ("été", "P", ["Été"]), ("a.b", "O", ["A.B"]), ("o_k", "P", [])]]
    parts = ["Ann", "ann", "ANN", "Lee", "lee", "Lees", "_ann", "été", "Été", "A.B", "axb", "o_k", "Zed", "x", "İ", "😀", ".", "\n"]
    for _ in range(600):
        text = rng.choice([" ", "  ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(25)))
        covered = [(a, a + 3) for a in (rng.randrange(max(1, len(text))) for _ in range(rng.randrange(3))) if a + 3 <= len(text)]
        got = [(m["start"], m["end"], m["entity_type"]) for m in propagate.mentions_in(text, seeds, [dict(start=a, end=b) for a, b in covered])]
        assert got == _mentions(text, seeds, covered), text


class _Read:
    def __init__(self, words):
        """Words of more than three characters are two sub-tokens; a special token stands at either end."""
        self.word_ids = [None, *[i for i, w in enumerate(words) for _ in range(1 + (len(w) > 3))], None]
        self.ids = list(range(len(self.word_ids)))
        self.attention_mask = [1] * len(self.ids)


class _Tokenizer:
    def encode(self, words, is_pretokenized):
        assert is_pretokenized
        self.words = words
        return _Read(words)


class _Input:
    def __init__(self, name):
        self.name = name


class _Session:
    """Answers a high logit for each capitalised word (label 0) and pair of them (label 1, likelier)."""

    def __init__(self, tokenizer, names):
        self.tokenizer, self.names, self.fed = tokenizer, names, None

    def get_inputs(self):
        return [_Input(n) for n in self.names]

    def run(self, outputs, feeds):
        assert outputs == ["logits"]
        self.fed = feeds
        words = self.tokenizer.words[self.tokenizer.words.index("<<SEP>>") + 1 :]
        out = np.full((1, len(words), 3, 2), -9.0)
        for i, w in enumerate(words):
            if w[0].isupper():
                out[0, i, 0, 0] = 1.0
                if i + 1 < len(words) and words[i + 1][0].isupper():
                    out[0, i, 1, 1] = 2.0
        return [out]


def test_span_model_encodes_and_decodes():
    names = ["input_ids", "attention_mask", "words_mask", "text_lengths", "span_idx", "span_mask"]
    tok = _Tokenizer()
    session = _Session(tok, names)
    model = S.SpanModel(tok, session, max_width=3, max_words=6)
    got = model("see Anna Lee and Bob-Roy, then Zed", ["name", "name", "date"], 0.5)
    assert [(s, e, label) for s, e, label, _ in got] == [(4, 12, "date"), (17, 24, "name")]  # Zed is beyond the last word read
    assert tok.words == ["<<ENT>>", "name", "<<ENT>>", "date", "<<SEP>>", "see", "Anna", "Lee", "and", "Bob-Roy", ","]
    fed = session.fed
    assert fed["text_lengths"].tolist() == [[6]] and fed["span_idx"].shape == (1, 18, 2) and fed["span_mask"][0].tolist() == [s[1] < 6 for s in fed["span_idx"][0].tolist()]
    mask = fed["words_mask"][0].tolist()
    assert [m for m in mask if m] == [1, 2, 3, 4, 5, 6] and len(mask) == len(fed["input_ids"][0])
    assert mask[tok.encode(tok.words, True).word_ids.index(6)] == 2  # the first of Anna's two sub-tokens
    few = S.SpanModel(tok, _Session(tok, names[:2]), 3, 6)
    few("Anna", ["name"], 0.5)
    assert sorted(few.session.fed) == ["attention_mask", "input_ids"]
    assert model("", ["name"], 0.5) == [] and model("Anna", [], 0.5) == []


@pytest.mark.parametrize("seed", range(5))
def test_decode_is_greedy_by_probability(seed):
    rng = np.random.default_rng(seed)
    logits = np.round(rng.normal(size=(9, 4, 3)), 1)
    p = 1 / (1 + np.exp(-logits.astype(np.float32)))
    ranked = sorted(((s, s + k, c, float(p[s, k, c])) for s in range(9) for k in range(4) for c in range(3) if s + k < 9 and p[s, k, c] > 0.6), key=lambda x: -x[3])
    want = []
    for x in ranked:
        if all(x[1] < y[0] or y[1] < x[0] for y in want):
            want.append(x)
    assert S.decode(logits, 0.6) == sorted(want)


def test_span_model_in_a_dataframe(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def build():
        tok = _Tokenizer()
        return S.SpanModel(tok, _Session(tok, ["input_ids"]), 3, 384)

    df = spark.createDataFrame([("see (Anna Lee) on\nMonday.",), (None,), ("",)], "text string")
    rows = ner.model_spans(df, build).collect()
    assert [(s.start, s.end, s.entity_type) for s in rows[0].spans] == [(5, 13, "ORGANIZATION"), (18, 24, "PERSON")]
    assert rows[1].spans == [] and rows[2].spans == []
