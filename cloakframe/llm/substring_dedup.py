"""Substring deduplication with an FM-index per shard and streamed matching statistics.

A window is 13 consecutive words; a word goes if a window over it also starts in a document of a
smaller id.  Equal windows have the same minimiser (the least hash of their 4-word grams), so:

1. Each document's minimisers are sorted by (minimiser, id) over range partitions, which a hot one
   may span; those with a neighbour of another document survive (a superset, decided locally).
2. Runs of windows with a surviving minimiser are cut out as segments and routed by it, so that all
   places of a repeated window meet in one shard.  The windows of a minimiser in more than
   ``HOT_PLACES`` places are routed one by one by their own hash instead.
3. A shard, in blocks of bounded size, indexes its distinct segments in an FM-index and streams them
   through it; the interval of every match of 13 words gives the smallest id where the window occurs.
4. The windows' smallest ids return to all places of a segment by a join on its hash, which adaptive
   execution splits where a segment is hot, and per document the covered words are removed.

Words are compared by 64-bit hashes, segments by their routing key and another 64-bit hash.  What one route
holds is bounded: a minimiser of at most ``HOT_PLACES`` places gives at most that many runs of ten windows.

Defined results: NULL, empty and short texts have no window and keep all words; rows without an id
neither lose words nor make others lose them; rows that share an id are one document (neither is
smaller); ids may be of any type that has an order (others than whole numbers are numbered in that order);
an empty table gives no rows; input columns named n_words or n_removed are replaced, all others (whatever
their names) are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import Own, Words, chunks, grams, mix, table, unpack, with_packed, written
from cloakframe.llm.fm_index import FMIndex

WINDOW = 13
GRAM = 4
HOT_PLACES = 2000
_ADDED = ("n_words", "n_removed")
#: Shortest run of one anchor in a partition whose length is reported.
_RUN = 256
#: Most windows in a segment, and about the most words in an index.
SEGMENT_WINDOWS = 64
BLOCK_WORDS = 400_000
_CHUNK_BYTES = 4_000_000


def window_minimisers(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows within one text, the minimiser of each)."""
    g = grams(w.hash, gram)
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, have = g, 1
    width = window - gram + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero(w.text[:n] == w.text[window - 1 :])
    return at, least[:n][at]


def _minimiser_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks([len(x) + 1 for x in texts], _CHUNK_BYTES):
                w = Words(texts[lo:hi])
                at, m = window_minimisers(w, window, gram)
                own = w.text[at]
                fresh = np.ones(len(m), bool)
                fresh[1:] = (m[1:] != m[:-1]) | (own[1:] != own[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(m[fresh].view(np.int64)), pa.array(ids[lo:hi][own[fresh]])], names=["anchor", "doc_id"])

    return docs.where("_doc is not null").select("_doc", "_text").mapInArrow(run, "anchor bigint, doc_id bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """(anchor, doc_id, run): rows whose anchor also occurs in another document, run 0; at a partition's
    ends, all.  Long runs of an anchor, and those at a partition's ends, also give a row without doc_id.
    """

    def emit(anchor: np.ndarray, doc: np.ndarray, edges: bool) -> pa.RecordBatch:
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(anchor)))
        differ = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        report = size >= _RUN
        if edges:
            differ[[0, -1]] = report[[0, -1]] = True
        keep = np.repeat(differ, size)
        n = int(report.sum())
        ids = pa.concat_arrays([pa.array(doc[keep]), pa.nulls(n, pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.append(anchor[keep], anchor[at[report]])), ids, pa.array(np.append(np.zeros(int(keep.sum()), np.int64), size[report]))], names=["anchor", "doc_id", "run"])

    def run(batches):
        anchor = doc = np.zeros(0, np.int64)
        edges = True
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, doc = np.append(anchor, batch.column(0).to_numpy()), np.append(doc, batch.column(1).to_numpy())
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if not cut and len(anchor) > 1_000_000:  # one anchor goes on and on: its parts are runs of their own
                cut, edges = len(anchor), True
            if cut:
                yield emit(anchor[:cut], doc[:cut], edges)
                anchor, doc, edges = anchor[cut:], doc[cut:], cut == len(anchor)
        if len(anchor):
            yield emit(anchor, doc, True)

    return rows.repartitionByRange("anchor", "doc_id").sortWithinPartitions("anchor", "doc_id").mapInArrow(run, "anchor bigint, doc_id bigint, run bigint")


def _segments(w: Words, anchors: list, hot: list, window: int, gram: int):
    """(route, hash, first window, windows, text) of each segment of the texts of w."""
    at, m = window_minimisers(w, window, gram)
    own = w.text[at]
    salt = mix(np.arange(len(anchors), dtype=np.uint64))

    def among(lists: list) -> np.ndarray:
        sizes = [0 if x is None else len(x) for x in lists]
        if not sum(sizes):
            return np.zeros(len(at), bool)
        wanted = np.concatenate([x for x in lists if x is not None and len(x)]).view(np.uint64) ^ np.repeat(salt, sizes)
        return np.isin(m ^ salt[own], wanted, kind="sort")

    take, alone = among(anchors), among(hot)
    pick = np.flatnonzero(take)
    at, m, own, alone = at[pick], m[pick], own[pick], alone[pick]
    if not len(at):
        return
    each = np.zeros(len(w.hash), np.uint64)
    g = grams(w.hash, window)
    each[: len(g)] = g
    route = np.where(alone, mix(each[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), m)
    new = np.ones(len(at), bool)
    new[1:] = (route[1:] != route[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(at)))
    parts = -(-length // SEGMENT_WINDOWS)
    start = np.repeat(start, parts) + SEGMENT_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(np.diff(np.append(start, len(at))), SEGMENT_WINDOWS)
    first = at[start]
    # a hash of the segment's windows, from their own hashes
    sums = np.append(np.uint64(0), np.cumsum(mix(each[at] + (np.arange(len(at)) - np.repeat(start, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    h = mix((sums[start + size] - sums[start]) ^ size.astype(np.uint64))
    return route[start].view(np.int64), h.view(np.int64), first, size, own[start]


def _cut(joined: DataFrame, window: int, gram: int, places: bool) -> DataFrame:
    """Segments of the candidates: each place of each (places), or each distinct one of a batch."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            texts = [unpack(x) if x and y else None for x, y in zip(batch.column(2).to_pylist(), batch.column(3).is_valid().to_pylist(), strict=True)]
            anchors = [None if x is None else np.asarray(x, np.int64) for x in batch.column(3).to_pylist()]
            hot = [np.asarray(x or [], np.int64) for x in batch.column(4).to_pylist()]
            rows, held = [i for i, a in enumerate(anchors) if a is not None and texts[i]], []
            for lo, hi in chunks([len(texts[i]) + 1 for i in rows], _CHUNK_BYTES):
                some = rows[lo:hi]
                w = Words([texts[i] for i in some])
                got = _segments(w, [anchors[i] for i in some], [hot[i] for i in some], window, gram)
                if got is None:
                    continue
                route, h, first, size, own = got
                doc = ids[some].astype(np.int64)[own]
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route), pa.array(h), pa.array(doc), pa.array(keys[some][own]), pa.array((first - w.first[own]).astype(np.int32))], names=["route", "h", "doc_id", "key", "pos"]
                    )
                    continue
                order = np.lexsort((doc, h, route))
                new = np.ones(len(order), bool)
                new[1:] = (route[order][1:] != route[order][:-1]) | (h[order][1:] != h[order][:-1])
                heads, last = order[new], order[np.append(np.flatnonzero(new)[1:], len(order)) - 1]
                begin, end = w.start[first[heads]], w.end[first[heads] + size[heads] + window - 2]
                text = [b" ".join(w.data[a:b].split()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                held.append((route[heads], h[heads], np.array(text, object), doc[heads], doc[last]))
            if held:
                route, h, text, least, most = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.lexsort((h, route))
                new = np.ones(len(order), bool)
                new[1:] = (route[order][1:] != route[order][:-1]) | (h[order][1:] != h[order][:-1])
                at = np.flatnonzero(new)
                heads = order[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[heads]), pa.array(h[heads]), pa.array(text[heads].tolist(), pa.binary()).cast(pa.string()), pa.array(np.minimum.reduceat(least[order], at)), pa.array(np.maximum.reduceat(most[order], at))],
                    names=["route", "h", "seg", "least", "most"],
                )

    schema = "route bigint, h bigint, doc_id bigint, key bigint, pos int" if places else "route bigint, h bigint, seg string, least bigint, most bigint"
    return joined.mapInArrow(run, schema)


def index_block(route: np.ndarray, h: np.ndarray, texts: list[bytes], least: np.ndarray, most: np.ndarray, window: int):
    """Index the distinct segments and stream them: (segment numbers, smallest id of each window)."""
    order = np.lexsort((h, route))
    new = np.ones(len(order), bool)
    new[1:] = (route[order][1:] != route[order][:-1]) | (h[order][1:] != h[order][:-1])
    at = np.flatnonzero(new)
    heads = order[at]
    least, most = np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)
    w = Words([texts[i] for i in heads])
    symbols = np.unique(w.hash, return_inverse=True)[1].astype(np.int64) + 1
    place = np.arange(len(symbols)) + w.text  # one separator before each segment but the first
    text = np.zeros(len(symbols) + len(heads), np.int64)
    text[place] = symbols
    index = FMIndex(text, window)
    owner = np.zeros(len(text), np.int64)
    owner[place] = least[w.text]
    owner[text == 0] = np.iinfo(np.int64).max
    smallest = np.minimum.reduceat(owner[index.order], index.full_at[:-1])
    result = np.full(len(symbols), -1, np.int64)
    found = np.zeros(len(symbols), bool)
    for starts, _, lo, _ in index.matching(symbols, w.first[:-1], w.count):
        result[starts] = smallest[index.full[lo]]
        found[starts] = True
    return heads, [result[a : a + n - window + 1] for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True)], least, most


def _indexed(segments: DataFrame, window: int, block_words: int) -> DataFrame:
    """(route, h, mins) of the segments some window of which is in two documents."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        route, h, least, most = (rows.column(c).to_numpy() for c in ("route", "h", "least", "most"))
        heads, mins, low, high = index_block(route, h, rows.column("seg").cast(pa.binary()).to_pylist(), least, most, window)
        use = [i for i, m in enumerate(mins) if high[i] > low[i] or (m < low[i]).any()]
        return pa.RecordBatch.from_arrays([pa.array(route[heads[use]]), pa.array(h[heads[use]]), pa.array([mins[i] for i in use], pa.list_(pa.int64()))], names=["route", "h", "mins"])

    def run(batches):
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            words += batch.column(2).nbytes // 7
            if words > block_words:
                rows = pa.Table.from_batches(held)
                route = rows.column("route").to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                if cut:
                    edges = np.unique(np.append(np.searchsorted(route, route[np.arange(0, cut, max(1, cut * block_words // words))]), cut))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        yield emit(rows.slice(a, b - a))
                    rows = rows.slice(cut).combine_chunks()
                    held, words = rows.to_batches(), rows.column("seg").nbytes // 7
        if held:
            yield emit(pa.Table.from_batches(held))

    return segments.repartition("route").sortWithinPartitions("route").mapInArrow(run, "route bigint, h bigint, mins array<bigint>")


def _numbered(df: DataFrame, doc: str) -> DataFrame:
    """df with _doc: the id as a number in the order of the ids."""
    if isinstance(df.schema[doc].dataType, T.IntegralType):
        return df.withColumn("_doc", F.col(doc).cast("bigint"))
    # partitions of a range are in order, and so are the numbers given inside and across them
    ids = df.select(F.col(doc).alias("_of")).where("_of is not null").distinct().repartitionByRange("_of").sortWithinPartitions("_of")
    ids = written(ids.withColumn("_doc", F.monotonically_increasing_id()), "ids")
    return df.join(ids, F.col(doc) == F.col("_of"), "left").drop("_of")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text: str = "text", hot_places: int = HOT_PLACES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with text as its kept words joined by one space, n_words and n_removed."""
    own = Own(docs)
    doc, body = own["doc_id"], own[text]
    gram = max(1, min(GRAM, window // 2))
    kept = [*dict.fromkeys([*own.kept(_ADDED), doc, body])]
    numbered = _numbered(own.df, doc).withColumn("_key", F.xxhash64(doc, body))
    base = numbered.select("_doc", "_key", F.col(body).alias("_text"))
    hits = written(_shared(_minimiser_rows(base, window, gram)), "anchors")
    runs = hits.where("doc_id is null").groupBy("anchor").agg(F.sum("run").alias("_n")).where(F.col("_n") > hot_places)
    hot = written(runs.select(F.col("anchor").alias("_hot")), "hot")
    marked = hits.where("doc_id is not null").join(hot, F.col("anchor") == F.col("_hot"), "left")
    lists = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("anchor").alias("_anchors"), F.collect_set("_hot").alias("_hot"))
    packed = with_packed(base, "_text")
    joined = packed.join(lists, F.col("_doc") == F.col("_id"), "left").select("_doc", "_key", "_text", "_anchors", "_hot")

    mins = _indexed(_cut(joined, window, gram, False), window, block_words)
    places = _cut(joined, window, gram, True)
    removed = places.join(mins, ["route", "h"]).select(
        "doc_id", "key", F.filter(F.transform("mins", lambda m, i: F.when(m < F.col("doc_id"), F.col("pos") + i)), lambda x: x.isNotNull()).alias("at")
    ).where(F.size("at") > 0)
    starts = removed.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("key", "at")).alias("_starts"))
    if set(kept) == {doc, body} and own.df.schema[doc].dataType == T.LongType():
        # the same rows as above, so that one exchange of the texts serves both joins
        both = packed.join(starts, F.col("_doc") == F.col("_id"), "left").select(*[F.col("_text" if c == body else "_doc").alias(c) for c in kept], "_key", "_starts")
    else:
        full = with_packed(numbered.select(*kept, "_doc", "_key"), body)
        both = full.join(starts, F.col("_doc") == F.col("_id"), "left").select(*kept, "_key", "_starts")
    at, schema = kept.index(body), T.StructType([*own.df.select(*kept).schema, T.StructField("_words", T.LongType()), T.StructField("_gone", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, words, gone = [], [], []
            keys = batch.column(len(kept)).to_pylist()
            for z, key, lists in zip(batch.column(at).to_pylist(), keys, batch.column(len(kept) + 1).to_pylist(), strict=True):
                x = None if z is None else unpack(z)
                own = (x or b"").split()
                drop = np.zeros(len(own) + 1, np.int32)
                for s in lists or []:
                    if s["key"] == key:
                        np.add.at(drop, np.asarray(s["at"]), 1)
                        np.add.at(drop, np.asarray(s["at"]) + window, -1)
                words.append(len(own))
                gone.append(0)
                if lists:
                    stay = np.cumsum(drop[:-1]) == 0
                    gone[-1] = int(len(own) - stay.sum())
                    own = [own[i] for i in np.flatnonzero(stay)]
                texts.append(None if x is None else b" ".join(own))
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(words, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, "_words", "_gone"])

    return own.back(both.mapInArrow(run, schema), {"n_words": "_words", "n_removed": "_gone"})


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from t where len(w) >= 13)),
f as (select g, min(doc_id) first from g group by g having min(doc_id) < max(doc_id)),
d as (select distinct doc_id, unnest(range(i, i + 13)) j from g join f using (g) where doc_id > first),
w as (select doc_id, unnest(w) x, generate_subscripts(w, 1) j from t),
k as (select doc_id, string_agg(x, ' ' order by j) s, count(*) n from w anti join d using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(s, '')) kept_sha256 from t left join k using (doc_id)
"""
