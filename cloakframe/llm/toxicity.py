"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or.

Only documents are labelled.  A sentence has the logit b + the weights of its tokens' features
(the word, and its prefixes of a few byte lengths); a document is toxic with probability
1 - prod(1 - p_sentence).  Weights are fitted by gradient steps on the document likelihood, so the
sentences that explain the labels get the weight and can then be located.

The fit uses at most ``MAX_DOCS`` labelled documents of at most ``MAX_BYTES`` together (a hash sample,
parameters ``max_docs`` and ``max_bytes``) on the driver, with at most ``MAX_FEATURES`` features; scoring
covers every whole text in vectorised bytes.

Defined results: NULL, empty and wordless texts have no sentence and score 0.0; without positive
training labels every score is 0.0; labels of unknown documents are unused; of documents that share an
id the least text is fitted on; rows without an id are scored and count as not held out; repeated rows are
scored alike; ids may be of any type; an empty table gives no rows; input columns named like an output are
replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, Words, chunks, in_fold, mix, read_texts, table
from cloakframe.llm.labelled import training_rows

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MAX_DOCS = 12_000
MAX_BYTES = 64_000_000
MAX_FEATURES = 4096
MIN_DOCS = 4
PREFIXES = (5, 6, 7, 8)
STEPS = 150

_CUT = np.zeros(256, bool)
_CUT[list(b".!?\n\r")] = True
#: A-Z to a-z; what is no letter, digit or byte of a non-ASCII character to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 47 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


class Tokens:
    """Words with their features and sentences; a sentence ends at . ! ? or a line's end."""

    def __init__(self, texts: list[bytes]):
        w = Words([x.translate(_FOLD) for x in texts])
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        cuts = np.cumsum(_CUT[raw])[w.start] if len(w.start) else np.zeros(0, np.int64)
        self.words, self.n_texts = w, len(texts)
        new = np.ones(len(cuts), bool)
        new[1:] = (cuts[1:] != cuts[:-1]) | (w.text[1:] != w.text[:-1])
        #: of each word its sentence, of each sentence its text and its bounds in bytes of the joined texts
        self.sentence = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.text = w.text[at]
        self.start = w.start[at]
        self.end = w.end[np.append(at[1:], len(cuts)) - 1] if len(at) else at

    def features(self):
        """(word indices, hashes) for each kind of feature."""
        w = self.words
        yield np.arange(len(w.hash)), w.hash
        for k in PREFIXES:
            at = np.flatnonzero(w.end - w.start > k)
            yield at, mix(w.prefix(at, k) + np.uint64(k))


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def logits(self, t: Tokens) -> np.ndarray:
        z = np.full(len(t.text), self.bias)
        if len(self.keys):
            for at, h in t.features():
                i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[i] == h
                z += np.bincount(t.sentence[at[hit]], self.weights[i[hit]], len(z))
        return z

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, Tokens, np.ndarray]:
        """Documents' probabilities; the tokens; the sentences' probabilities."""
        t = Tokens(texts)
        z = self.logits(t)
        loss = np.bincount(t.text, np.logaddexp(0, z), len(texts))
        return -np.expm1(-loss), t, 1 / (1 + np.exp(-z))


def _document_features(texts: list[bytes]):
    """For chunks of the texts: (first text, features, texts), each pair of feature and text once."""
    for lo, hi in chunks([len(x) + 1 for x in texts], 1_000_000):
        t = Tokens(texts[lo:hi])
        for at, h in t.features():
            text = t.words.text[at]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield h[first], text[first] + lo


def _counts(texts: list[bytes], y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of at least ``least`` toxic texts, and in how many toxic and other texts each occurs."""
    keys, pos = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for h, _ in _document_features([x for x, own in zip(texts, y, strict=True) if own == 1]):
        one, n = np.unique(h, return_counts=True)
        keys, at = np.unique(np.append(keys, one), return_inverse=True)
        pos = np.bincount(at, np.append(pos, n), len(keys)).astype(np.int64)
    keys, pos = keys[pos >= least], pos[pos >= least]
    neg = np.zeros(len(keys), np.int64)
    for h, _ in _document_features([x for x, own in zip(texts, y, strict=True) if own == 0]) if len(keys) else ():
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        neg += np.bincount(i[keys[i] == h], minlength=len(keys))
    return keys, pos, neg


def fit(texts: list[bytes], labels: list[int], max_features: int = MAX_FEATURES, steps: int = STEPS) -> Model:
    y = np.asarray(labels, np.int64)
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0 if not n_pos else 0.0)
    keys, pos, neg = _counts(texts, y, MIN_DOCS)
    odds = np.log((pos + 0.1) / (n_pos + 0.2)) - np.log((neg + 0.1) / (n_neg + 0.2))
    strength = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    chosen = np.sort(np.argsort(-strength)[:max_features])
    chosen = chosen[strength[chosen] > 3]
    keys, odds = keys[chosen], odds[chosen]

    rows, columns, sentence_text, empty, done = [], [], [], np.zeros(len(texts)), 0
    for lo, hi in chunks([len(x) + 1 for x in texts], 1_000_000):
        t = Tokens(texts[lo:hi])
        s, f = [], []
        for at, h in t.features():
            i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            s.append(t.sentence[at[hit]])
            f.append(i[hit])
        s, f = np.concatenate(s), np.concatenate(f)
        used, s = np.unique(s, return_inverse=True)
        total, own = np.bincount(t.text, minlength=hi - lo), np.bincount(t.text[used], minlength=hi - lo)
        empty[lo:hi] = total - own
        rows.append(s + done)
        columns.append(f)
        sentence_text.append(t.text[used] + lo)
        done += len(used)
    row, column, text = np.concatenate(rows), np.concatenate(columns), np.concatenate(sentence_text)

    theta = np.append(np.clip(odds, 0, 4) * 0.5, -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(row, w[column], done)
        loss = np.bincount(text, np.logaddexp(0, z), len(texts)) + empty * np.logaddexp(0, b)
        slope = np.where(y == 1, -1 / np.expm1(np.clip(loss, 1e-9, 500)), 1.0) / len(texts)
        slope[empty + np.bincount(text, minlength=len(texts)) == 0] = 0
        dz = slope[text] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(column, dz[row], len(w)) + 1e-5 * w, dz.sum() + (slope * empty).sum() / (1 + np.exp(-b)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(keys, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, max_docs: int = MAX_DOCS, text: str = "text", max_bytes: int = MAX_BYTES) -> Model:
    """A model from labelled documents outside the held-out fold."""
    some = training_rows(docs, labels, label, lambda i: in_fold(i, folds, held_out), max_docs, max_bytes, text)
    got = some.orderBy("_id").select(F.col("_t").cast("binary").alias("t"), F.col("_y").alias("y")).toArrow()
    return fit(got.column("t").to_pylist(), got.column("y").to_pylist())


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score, predicted and offending: (start, end, p) in bytes of each sentence from threshold on."""
    own = Own(docs)
    mine = own.kept(("score", "predicted", "offending"), keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> dict:
        p, t, each = shared.value.score(texts)
        begin = np.append(0, t.words.text_end[:-1])
        offending: list[list[dict]] = [[] for _ in texts]
        for i in np.flatnonzero(each >= threshold).tolist():
            at = int(t.text[i])
            offending[at].append({"start": int(t.start[i] - begin[at]), "end": int(t.end[i] - begin[at]), "p": float(each[i])})
        return {"_score": p, "_predicted": (p >= threshold).astype(np.int32), "_offending": offending}

    scored = read_texts(own, mine, "_score double, _predicted int, _offending array<struct<start:int,end:int,p:double>>", compute, text)
    return own.back(scored, {"score": "_score", "predicted": "_predicted", "offending": "_offending"}, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
