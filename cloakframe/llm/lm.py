"""Language-model scoring with a gated recurrent network over whole documents.

1. Token counts of all training documents: partial counts per task, one shuffle, a written table.
2. The vocabulary: all words at or above a frequency (at most ``TOP_WORDS``, so their table may be
   broadcast) of which the first ``WORDS`` are the network's own; every other word belongs to one of
   ``TAILS`` tail classes by a hash of its last bytes, and inside its class has the probability
   (c + 1) / (tokens + words + 1 of the class); unknown words are the class's +1.
3. Training: first weights from one in ``WARM_SHARE`` texts (about ``WARM_TEXTS`` where that is fewer), picked
   and ordered by a hash of doc_id and read by the driver one partition at a time; then texts, as 16-bit
   ids, fall into shards by a hash of the row, a task trains one pass by truncated backpropagation over each
   of its shards in the order of the hashes, and the weights are averaged by tokens in a tree of bounded
   groups.  Nothing of this depends on how the rows came partitioned.
4. Scoring: the network runs over the ids of every whole text; rare words meet their counts in a shuffled join (their
   counts are below the vocabulary's frequency, so no key is hot) and return as sums per document.

Texts are read twice: for the counts, and into a written table of ids that training and scoring share.

Defined results: NULL texts are empty; an empty text is its end token; repeated rows are scored alike;
rows without an id are training rows; ids may be of any type; without training documents N = 0, every
word is unknown and the scores are those of untrained weights; an empty table gives no rows; input columns
named like an output are replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import gru
from cloakframe.llm.common import Own, append_from_text, chunks, in_fold, table, written

FOLDS, HELD_OUT = 7, 2
WORDS, CLASSES, TAILS = 1024, 32, 32
TOP_WORDS = 150_000
WARM_TEXTS, WARM_SHARE = 192, 1000
#: Tokens in a training shard, and the most shards (beyond, they hold more tokens).
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 16_384
_READ = "_ids binary, _n bigint, _known bigint, _base double, _inner double, _rare array<struct<word:string,n:bigint>>"
#: Most bytes of ids that are scored at once, and of texts that are cut at once.
_SCORE_BYTES, _CUT_BYTES = 16_000_000, 8_000_000
_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: The end token; no word holds a line's end.
END = b"\n"
_CHUNK = 4096
_FLUSH = 400_000
_TRAIN_TOKENS = 400_000


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@cache
def _tails_by_ends() -> np.ndarray:
    """tail_of by the last two bytes; by the last one, of words of one byte, from 65536 on."""
    ends = [bytes((a, b)) for a in range(256) for b in range(256)] + [bytes((b,)) for b in range(256)]
    return np.array([tail_of(x) for x in ends], np.int32)


def tails_of(words: pa.Array) -> np.ndarray:
    """tail_of of each of the words (of which one at least has a byte; what an empty one gets means nothing)."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data, last = np.frombuffer(data, np.uint8), np.maximum(ends[1:] - 1, 0)
    before = np.where(np.diff(ends) > 1, data[np.maximum(last - 1, 0)].astype(np.int32), 256)
    return _tails_by_ends()[before * 256 + data[last]]


@dataclass
class Cut:
    """The tokens of many texts: the words among them, once each (some may have no token), the place of each token
    among the words, and how many tokens there are up to the end of each text.
    """

    words: pa.Array
    at: np.ndarray
    ends: np.ndarray


def cut(texts: list[bytes]) -> Cut:
    """The same tokens as those of tokens(), cut and told apart by Arrow."""
    lists = pc.ascii_split_whitespace(pa.array([x.lower() for x in texts], pa.binary()).view(pa.string()))
    coded = lists.flatten().dictionary_encode()
    found = coded.indices.to_numpy()
    real = found != pc.index(coded.dictionary, "").as_py()  # where whitespace begins or ends a text
    before = np.append(0, np.cumsum(real))[lists.offsets.to_numpy()]
    ends = before[1:] + np.arange(1, len(texts) + 1)
    at, is_word = np.full(ends[-1], len(coded.dictionary), np.int32), np.ones(ends[-1], bool)
    is_word[ends - 1] = False
    at[is_word] = found[real]
    words = pa.concat_arrays([coded.dictionary, pa.array([END.decode()])])
    return Cut(words.view(pa.binary()), at, ends)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, tail, c) over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

        def flush() -> pa.RecordBatch:
            words, n = (pa.concat_arrays(held[0][c].chunks) for c in ("word", "n"))
            held.clear()
            return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(tails_of(words), pa.int32()), n], names=["word", "tail", "n"])

        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks([len(x) + 1 for x in texts], _CUT_BYTES):
                c = cut(texts[lo:hi])
                n = np.bincount(c.at, minlength=len(c.words))
                held.append(pa.table({"word": c.words, "n": n}).filter(pa.array(n > 0)))
                if sum(map(len, held)) > 2 * _FLUSH:
                    held[:] = [merged()]
                    if len(held[0]) > _FLUSH:
                        yield flush()
        if held:
            held[:] = [merged()]
            yield flush()

    return docs.select(text).mapInArrow(run, "word string, tail int, n bigint").groupBy("word", "tail").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Frequent words with their counts, and the totals; what a task needs to read a text."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, tail_tokens: np.ndarray, tail_words: np.ndarray):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        self.tail_log = -np.log10(tail_tokens + tail_words + 1.0)
        self.id_counts = np.append(np.append(counts[:WORDS], np.zeros(max(0, WORDS - len(counts)))), tail_tokens)
        self._read: dict | None = None
        self._set: pa.Array | None = None

    def __getstate__(self):
        return self.__dict__ | {"_read": None, "_set": None}

    @property
    def read(self) -> dict[bytes, int]:
        if self._read is None:
            self._read = {w: i for i, w in enumerate(self.words)}
        return self._read

    @property
    def end(self) -> int:
        return self.ids([END])[0]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The network's ids."""
        at = np.fromiter(map(self.read.get, words, repeat(-1)), np.int32, len(words))
        tail = np.flatnonzero((at < 0) | (at >= WORDS))
        at[tail] = [WORDS + tail_of(words[i]) for i in tail.tolist()]
        return at

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks among the frequent words, -1 for others; the network's ids."""
        if self._set is None:
            self._set = pa.array(self.words, pa.binary())
        at = pc.index_in(words, value_set=self._set).fill_null(-1).to_numpy()
        return at, np.where((at >= 0) & (at < WORDS), at, WORDS + tails_of(words))


def vocabulary(counts: DataFrame, top_words: int = TOP_WORDS) -> Vocabulary:
    level = F.floor(F.log2("c") * 8)
    by_level = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, top_words
    for at, n in by_level:
        if n > room:
            break
        least, room = at, room - n
    top = counts.where(level >= least).select("word", "c").toPandas() if least is not None else pd.DataFrame({"word": [], "c": []})
    top = top.sort_values(["c", "word"], ascending=[False, True])
    words = [w.encode() for w in top["word"]]
    tails = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    n, v = sum(r.c for r in tails), sum(r.n for r in tails)
    tail_tokens, tail_words = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        tail_tokens[r.tail], tail_words[r.tail] = r.c, r.n
    for w, c in zip(words[:WORDS], top["c"], strict=False):
        tail_tokens[tail_of(w)] -= c
        tail_words[tail_of(w)] -= 1
    return Vocabulary(words, top["c"].to_numpy(float), n, v, tail_tokens, tail_words)


def _shapes(p: gru.Params) -> list[tuple[str, tuple]]:
    return [(k, v.shape) for k, v in sorted(p.items())]


def _flat(p: gru.Params) -> np.ndarray:
    return np.concatenate([v.ravel() for _, v in sorted(p.items())])


def _unflat(flat: np.ndarray, shapes: list[tuple[str, tuple]]) -> gru.Params:
    out, at = {}, 0
    for k, shape in shapes:
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _average(rows: DataFrame, *keys: str) -> DataFrame:
    """Weights averaged by tokens; summed in the order of shards, so that the result is always the same."""

    def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", kind="stable")
        n = pdf["n"].to_numpy()
        w = (np.stack(pdf["w"].to_numpy()) * (n / n.sum())[:, None]).sum(0)
        return pd.DataFrame({"chunk": [key[0]], "shard": [key[1] if len(key) > 1 else 0], "n": [n.sum()], "w": [w.astype(np.float32)]})

    return rows.groupBy(*keys).applyInPandas(mean, "chunk int, shard int, n double, w array<float>")


def warm_texts(docs: DataFrame, n: int, text: str = "text", least: int = WARM_TEXTS, share: int = WARM_SHARE) -> DataFrame:
    """(_h, _t): the share of n rows of docs, or about least, by a hash; the same for any layout of the rows."""
    own = Own(docs)
    t, i = F.coalesce(F.col(own[text]), F.lit("")).cast("binary"), F.col(own["doc_id"])
    h = F.xxhash64(i, F.when(i.isNull(), t))
    part = max(1 / share, min(1.0, least / max(1, n)))
    picked = own.df.select(h.alias("_h"), t.alias("_t")).where(F.pmod("_h", F.lit(1 << 30)) < int(part * (1 << 30)))
    return written(picked, "warm_texts").orderBy("_h", "_t")


@dataclass
class Read:
    """Documents as the network's ids, with what the counts alone say of them: a written table (see read_documents)."""

    own: Own
    keep: list[str] | None
    rows: DataFrame


def read_documents(docs: DataFrame, vocab: Vocabulary, keep: list[str] | None = None, text: str = "text") -> Read:
    """One pass over the texts that serves training and scoring: per row

    _row, _h (a hash of the row), _ids (16 bits each), _n (tokens), _known and _base (of the frequent words: how many, and
    their log counts), _inner (what words have inside their tail class) and _rare (the words that still need their counts).
    """
    own = Own(docs)
    mine = own.kept(_ADDED, keep)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    body = own[text]
    rows = own.df.select(*dict.fromkeys([*mine, body]), F.xxhash64(own["doc_id"], body).alias("_h"))
    read = append_from_text(rows, _READ, lambda x: _read_texts(x, shared.value), body, drop=body not in mine)
    return Read(own, keep, written(read.withColumn("_row", F.monotonically_increasing_id()), "tokens"))


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", shard_tokens: int = SHARD_TOKENS, rows: DataFrame | None = None) -> gru.Params:
    """Weights after one pass over all rows of docs, the same for any layout of the rows; rows: docs as read, if they are.

    Rows fall into shards by hash, are trained on in the order of their hashes, and shards are as many as the tokens ask for.
    """
    rows = read_documents(docs, vocab, [], text).rows if rows is None else rows
    p = gru.start(WORDS, CLASSES, TAILS, vocab.id_counts)
    warm = [vocab.ids(tokens(bytes(r._t))) for r in warm_texts(docs, docs.count(), text).toLocalIterator()]
    for _ in range(2):
        if warm:
            gru.train(p, np.concatenate(warm), vocab.end, streams=32)
    shapes = _shapes(p)
    shared, end = docs.sparkSession.sparkContext.broadcast(_flat(p)), vocab.end
    shards = max(1, min(MOST_SHARDS, round(vocab.n / shard_tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value
        now, own, held, size, total = -1, None, [], 0, 0

        def learn() -> None:
            nonlocal size, total
            if held:
                gru.train(own, np.concatenate(held), end)
                total += size
                held.clear()
                size = 0

        def done() -> pa.RecordBatch:
            learn()
            new = _flat(own)
            parts = [new[i : i + _CHUNK] for i in range(0, len(new), _CHUNK)]
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([now] * n, pa.int32()), pa.array([float(total)] * n), pa.array(parts, pa.list_(pa.float32()))], names=["chunk", "shard", "n", "w"])

        for batch in batches:
            for shard, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if own is not None:
                        yield done()
                    now, own, total = shard, _unflat(flat, shapes), 0
                ids = np.frombuffer(x, np.uint16).astype(np.int32)
                held.append(ids)
                size += len(ids)
                if size >= _TRAIN_TOKENS:
                    learn()
        if own is not None:
            yield done()

    rows = rows.select("_h", "_ids", F.pmod("_h", F.lit(shards)).cast("int").alias("_shard"))
    dealt = rows.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_h", "_ids").select("_shard", "_ids")
    trained = dealt.mapInArrow(run, "chunk int, shard int, n double, w array<float>")
    trained = _average(trained.withColumn("group", F.floor(F.col("shard") / 64).cast("int")), "chunk", "group")
    got = _average(trained, "chunk").orderBy("chunk").select("w").collect()
    return _unflat(np.concatenate([np.asarray(r.w, np.float32) for r in got]), shapes) if got else p


def _read_texts(texts: list[bytes], vocab: Vocabulary) -> dict:
    c = cut(texts)
    at, own = vocab.places(c.words)
    log_count = np.append(np.log10(vocab.counts + 1.0), 0.0)[at]  # the last one is that of rare words
    inner = np.where(at >= WORDS, log_count, 0.0) + np.append(np.zeros(WORDS), vocab.tail_log)[own]
    begin = np.append(0, c.ends)
    in_text = lambda of_word: np.add.reduceat(of_word[c.at], begin[:-1])  # noqa: E731 - each text has a token
    ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * begin).astype(np.int32)), pa.py_buffer(own.astype(np.uint16)[c.at])])
    is_rare = np.flatnonzero((at < 0)[c.at])
    both, n = np.unique(np.searchsorted(c.ends, is_rare, "right") * len(c.words) + c.at[is_rare], return_counts=True)
    text, word = both // len(c.words), both % len(c.words)
    counted = pa.StructArray.from_arrays([c.words.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), counted)
    return {"_ids": ids, "_n": np.diff(begin), "_known": in_text((at >= 0).astype(np.int64)), "_base": in_text(log_count), "_inner": in_text(inner), "_rare": rare}


def score_read(read: Read, counts: DataFrame, vocab: Vocabulary, p: gru.Params) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score."""
    shared, end = read.rows.sparkSession.sparkContext.broadcast(p), vocab.end

    def network(ids: list[bytes]) -> dict:
        return {"_network": gru.score(shared.value, [np.frombuffer(x, np.uint16).astype(np.int32) for x in ids], end) / np.log(10)}

    scored = append_from_text(read.rows.drop("_rare", "_h"), "_network double", network, "_ids", most=_SCORE_BYTES, drop=True)
    rare = read.rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.n").join(counts.select("word", "c"), "word", "left")
    sums = rare.groupBy(F.col("_row").alias("_of")).agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_rk"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_rl"))
    both = scored.join(sums, F.col("_row") == F.col("_of"), "left")
    rare_log = F.coalesce("_rl", F.lit(0.0))
    per_token = float(np.log10(vocab.n + vocab.v + 1.0))
    outputs = {
        "n_tokens": "_n", "n_known": (F.col("_known") + F.coalesce("_rk", F.lit(0))).cast("long"), "train_tokens": F.lit(vocab.n).cast("long"),
        "base_score": F.col("_base") + rare_log - F.col("_n") * F.lit(per_token), "score": F.col("_network") + F.col("_inner") + rare_log,
    }
    return read.own.back(both, outputs, read.keep)


def score_documents(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, p: gru.Params, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs (or its columns in keep) with n_tokens, n_known, train_tokens, base_score and score."""
    return score_read(read_documents(docs, vocab, keep, text), counts, vocab, p)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    training = docs.where(~held_out)
    counts = written(token_counts(training), "token_counts")
    vocab = vocabulary(counts)
    read = read_documents(docs, vocab, ["doc_id"])
    p = train(training, vocab, rows=read.rows.where(~in_fold(F.col(read.own["doc_id"]), FOLDS, HELD_OUT)))
    return score_read(read, counts, vocab, p).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
