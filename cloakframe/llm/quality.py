"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text (shape of words, symbols, repetition, lines) has a lookup table over quantile
bins, learned by cyclic boosting of shallow trees: round after round each feature in turn gets a tree
of up to three leaves on the current residuals, added with a small rate.  The pairs of features whose
residuals interact most then get two-dimensional tables in the same way.  A score is the logistic of
the sum of table entries, so scoring is a vectorised addition of binned values.

The tables are fitted on the driver from at most ``MAX_ROWS`` labelled rows of at most ``MAX_BYTES`` of text
together (a hash sample, parameters ``max_rows`` and ``max_bytes``); only their features leave the
executors.  Scoring covers every whole text.

Defined results: NULL, empty and wordless texts have all features 0 and get the score of those bins;
with labels of one value only, or none, every score is the smoothed rate of label 1 (0.5 without
labels); of documents that share an id the least text is fitted on; rows without an id are scored and
count as not held out; repeated rows are scored alike; ids may be of any type; an empty table gives no
rows; input columns named like an output are replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, Words, append_from_text, in_fold, read_texts, table
from cloakframe.llm.host_rules import repeated_words
from cloakframe.llm.labelled import training_rows

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
MAX_ROWS = 20_000
MAX_BYTES = 256_000_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.1

FEATURES = [
    "log_words", "mean_word", "upper", "symbols", "exclaims", "bars", "digits", "stops", "non_ascii",
    "distinct_words", "same_as_before", "repeated_windows", "repeated_lines", "words_per_line", "spaces", "long_words", "short_words",
]

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "letters": ((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128),
    "symbols": np.isin(_B, list(b"#*$%&<>@^~_={}[]\\/")),
    "exclaims": _B == 33,
    "bars": _B == 124,
    "digits": (_B >= 48) & (_B <= 57),
    "stops": np.isin(_B, list(b".,;:")),
    "non_ascii": _B >= 192,
    "spaces": np.isin(_B, list(b" \t")),
    "lines": _B == 10,
}


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    w = Words(texts)
    b = np.frombuffer(w.data, np.uint8)
    ends = w.text_end - 1
    starts = np.append(0, w.text_end[:-1])

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return (sums[ends] - sums[starts]).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return (sums[w.first[1:]] - sums[w.first[:-1]]).astype(float)

    c = {k: total(f[b]) for k, f in _CLASSES.items()}
    n, size = w.count.astype(float), (ends - starts).astype(float)
    n1, size1 = np.maximum(n, 1), np.maximum(size, 1)
    length = w.end - w.start
    order = np.lexsort((w.hash, w.text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    distinct = np.bincount(w.text[order][fresh], minlength=len(texts))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    dup = np.zeros(len(texts))
    for i, x in enumerate(texts):
        lines = [y for y in x.split(b"\n") if y.strip()]
        dup[i] = (len(lines) - len(set(lines))) / max(len(lines), 1)
    columns = [
        np.log1p(n), per_word(length) / n1, c["upper"] / np.maximum(c["letters"], 1), c["symbols"] / size1, c["exclaims"] / n1, c["bars"] / n1, c["digits"] / size1, c["stops"] / n1, c["non_ascii"] / size1,
        distinct / n1, per_word(again) / n1, repeated_words(w, 5) / n1, dup, n / (c["lines"] + 1), c["spaces"] / n1, per_word(length > 12) / n1, per_word(length <= 2) / n1,
    ]
    out = np.column_stack(columns) if texts else np.zeros((0, len(FEATURES)))
    out[n == 0] = 0
    return out


@dataclass
class Gam:
    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)  # upper bounds of the bins of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # from a feature's bin to its pair bin
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.cuts and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step function over bins from gradient and curvature sums: best splits, greedily."""
    parts = [(0, len(g))]
    gain_of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                left_g, left_h = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
                gains = left_g**2 / (left_h + 1.0) + (g[lo:hi].sum() - left_g) ** 2 / (h[lo:hi].sum() - left_h + 1.0) - gain_of(lo, hi)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Gam:
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Gam(float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    n_features = x.shape[1]
    for j in range(n_features):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
        size = len(model.cuts[j]) + 1
        model.tables.append(np.zeros(size))
        model.coarse.append(np.arange(size) * PAIR_BINS // max(size, PAIR_BINS))
    b = model.bins(x)
    z = np.full(len(y), model.bias)
    for _ in range(rounds):
        for j in range(n_features):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(*(np.bincount(b[:, j], v, len(model.tables[j])) for v in (y - p, p * (1 - p))))
            model.tables[j] += step
            z += step[b[:, j]]
    p = 1 / (1 + np.exp(-z))
    found = []
    for i, j in combinations(range(n_features), 2):
        cell = model.coarse[i][b[:, i]] * PAIR_BINS + model.coarse[j][b[:, j]]
        g, h = (np.bincount(cell, v, PAIR_BINS**2) for v in (y - p, p * (1 - p)))
        found.append((float((g * g / (h + 1.0)).sum()), i, j))
    for _, i, j in sorted(found, reverse=True)[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((PAIR_BINS, PAIR_BINS)))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            cell = model.coarse[i][b[:, i]] * PAIR_BINS + model.coarse[j][b[:, j]]
            g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p)))
            rows = _tree(g.sum(1), h.sum(1))  # a first split by one feature, then each side by the other
            step = np.zeros_like(g)
            for value in np.unique(rows):
                side = rows == value
                step[side] = _tree(g[side].sum(0), h[side].sum(0))
            model.pair_tables[k] += RATE * step
            z += RATE * step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, max_rows: int = MAX_ROWS, text: str = "text", max_bytes: int = MAX_BYTES) -> Gam:
    """A model from labelled documents outside the held-out fold."""
    some = training_rows(docs, labels, label, lambda i: in_fold(i, folds, held_out), max_rows, max_bytes, text)
    read = append_from_text(some, "_x array<double>", lambda t: {"_x": list(features(t))}, "_t", drop=True)
    got = read.orderBy("_id").select("_x", "_y").toArrow()
    x = np.array(got.column("_x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("_y").to_pylist(), float))


def score_documents(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score and predicted."""
    own = Own(docs)
    mine = own.kept(("score", "predicted"), keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> dict:
        p = shared.value.score(features(texts))
        return {"_score": p, "_predicted": (p >= threshold).astype(np.int32)}

    scored = read_texts(own, mine, "_score double, _predicted int", compute, text)
    return own.back(scored, {"score": "_score", "predicted": "_predicted"}, keep)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
