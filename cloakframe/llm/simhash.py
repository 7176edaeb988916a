"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are linked at three or fewer differing bits, so two linked fingerprints
share at least five of their eight positional bytes.  Any five positions hold three of the first
four bytes or three of the last four; the index therefore posts each distinct fingerprint under its
eight triples of bytes (byte positions and values), which no link can miss.  Within a posting list
the shared positional bytes of each pair are tallied, pairs reaching five stay, and their bits are
compared.  A list over ``LIST_LIMIT`` is not paired but posted anew under all 56 sets of five bytes
(exact: a link shares five).  Such a list has 24 free bits, so at most 2**24 fingerprints however large
the corpus; where it is over the limit again, its free bits are parted in four and only those equal in
one part are paired (exact: three differing bits leave a part untouched).  Only edges that join different
trees leave a list, so a group of copies gives links in proportion to its size.

Defined results: NULL, empty and wordless texts have fingerprint zero and are linked like any other;
rows without an id get the component's smallest id, NULL if it has none; repeated rows get the same
result, and of rows that share a group's smallest id one stays; ids may be of any type that has an order;
an empty table gives no rows; input columns named fingerprint or component_id are replaced by
near_duplicates, all others (whatever their names) are returned, and one_of_each returns all as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, read_texts, table, written
from cloakframe.llm.graph import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SHARED_BYTES = 8 - MOST_BITS
LIST_LIMIT = 4096

TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), SHARED_BYTES))


def _hashes(text: bytes, k: int) -> list[int]:
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return [digest(b" ".join(words), SEED)] if words else []
    if k == 3:
        return [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    return [digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i, x in enumerate(texts):
        h = np.array(_hashes(x, k), "<u8")
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 4096):
                ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _postings(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """The index keys of a fingerprint: the number of the set of positions, then the bytes there."""
    keys = []
    for n, positions in enumerate(sets):
        key = F.lit(n).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    return F.explode(F.array(*keys))


def link_lists(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of each posting list; keys are sorted."""
    octets = fps.view(np.uint8).reshape(-1, 8)
    bits = fps.view(np.uint64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    edges = []
    at = np.arange(len(keys) - 1)
    step = 1
    while len(at := at[at + step < len(keys)]):
        at = at[keys[at] == keys[at + step]]
        for lo in range(0, len(at), 1 << 18):
            i = at[lo : lo + (1 << 18)]
            j = i + step
            tally = (octets[i] == octets[j]).sum(1)
            near = tally >= SHARED_BYTES
            i, j = i[near], j[near]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= MOST_BITS
            for a, b in zip(fps[i[near]].tolist(), fps[j[near]].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((a, b))
        step += 1
    return edges


def _cells(fps: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Lists of at most limit of the distinct fps that hold every linked pair together.

    The bits in which the fps differ are parted in four; a linked pair is equal in one part at least, so
    the fps that share a part's bits form a list, parted again while it is long.
    """
    spread = int(np.bitwise_or.reduce(fps.view(np.uint64) ^ fps.view(np.uint64)[0]))
    bits = [b for b in range(64) if spread >> b & 1]
    if len(fps) <= limit or len(bits) <= MOST_BITS:
        yield fps
        return
    for part in np.array_split(bits, MOST_BITS + 1):
        shared = fps.view(np.uint64) & np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(shared, kind="stable")
        ends = np.flatnonzero(np.append(shared[order][1:] != shared[order][:-1], True)) + 1
        for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            if hi - lo > 1:
                yield from _cells(fps[order[lo:hi]], limit)


def _pair(postings: DataFrame, limit: int, last: bool) -> DataFrame:
    """(u, v, long): edges, and, but for the last index, (u, NULL, true) for the members of lists over the limit."""

    def emit(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        long = np.zeros(0, np.int64)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        big = np.repeat(counts > limit, counts)
        edges = link_lists(keys[~big], fps[~big])
        if last:
            for at in np.flatnonzero(counts > limit).tolist():
                cells = list(_cells(fps[first[at] : first[at] + counts[at]], limit))
                edges += link_lists(np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells))
        else:
            long = fps[big]
        u = pa.array([a for a, _ in edges] + long.tolist(), pa.int64())
        v = pa.array([b for _, b in edges] + [None] * len(long), pa.int64())
        return pa.RecordBatch.from_arrays([u, v, pa.array([False] * len(edges) + [True] * len(long), pa.bool_())], names=["u", "v", "long"])

    def passed(fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array([True] * len(fps), pa.bool_())], names=["u", "v", "long"])

    def run(batches):
        keys = fps = np.zeros(0, np.int64)
        over = None  # the key of a list over the limit whose members are passed on as they come
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if over is not None:
                cut = np.searchsorted(keys, over, "right")
                yield passed(fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                over = over if not len(keys) else None
            if len(keys) and keys[0] != keys[-1]:
                cut = np.searchsorted(keys, keys[-1])
                yield emit(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if not last and len(keys) > limit:
                over = keys[0]
                yield passed(fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield emit(keys, fps)

    return postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u bigint, v bigint, long boolean")


def links(distinct: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all that are linked; distinct: (fp)."""
    first = written(_pair(distinct.select(_postings(F.col("fp"), TRIPLES).alias("key"), "fp"), list_limit, False), "links")
    again = first.where("long").select(F.col("u").alias("fp")).distinct()
    second = _pair(again.select(_postings(F.col("fp"), FIVES).alias("key"), "fp"), list_limit, True)
    return first.where("not long").select("u", "v").unionByName(second.select("u", "v"))


def _grouped(own: Own, mine: list[str], shingle: int, text: str) -> DataFrame:
    """mine (columns of own) with _row, _id, _fp, _root (the group) and _least (its smallest id)."""
    doc = own["doc_id"]
    marked = read_texts(own, [*mine, doc], "_fp bigint", lambda x: {"_fp": fingerprints(x, shingle)}, text)
    base = written(marked.select(*mine, F.col(doc).alias("_id"), F.monotonically_increasing_id().alias("_row"), "_fp"), "fingerprints")
    distinct = base.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("_doc"))
    stars = components(links(distinct.select("fp")))
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "_doc", F.coalesce("root", "fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_doc").alias("_least"))
    return base.join(rooted.join(least, "_root").select("fp", "_root", "_least"), F.col("_fp") == F.col("fp"))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """keep (default: all columns) with fingerprint (hex) and component_id (smallest linked doc_id)."""
    own = Own(docs)
    found = _grouped(own, own.kept(("fingerprint", "component_id"), keep), shingle, text)
    return own.back(found, {"fingerprint": F.lpad(F.lower(F.hex("_fp")), 16, "0"), "component_id": "_least"}, keep)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id, with the columns of docs as they were."""
    own = Own(docs)
    found = _grouped(own, own.all(), shingle, text)
    stays = found.where(F.col("_id").eqNullSafe(F.col("_least"))).groupBy("_root").agg(F.min("_row").alias("_stays"))
    return own.back(found.join(stays, F.col("_row") == F.col("_stays"), "left_semi"), {})


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, ["doc_id"]).select("doc_id", "fingerprint", "component_id")
