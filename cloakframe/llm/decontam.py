"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive benchmark words is a pattern (an item of fewer words is one
pattern).  For each pattern length, a shift table over blocks of two words says how far the
search may jump, the blocks that end a pattern select a bucket of patterns, and a direct
comparison confirms each occurrence.  Patterns reach the executors in blocks of bounded size
(``BLOCK_CHARS``).  A benchmark of one block takes one pass and no shuffle; for a larger one, separate tasks
search the texts for each block, so that a task holds one block's patterns whatever the benchmark's
size, and only the hits are shuffled, to meet by row.

Defined results: NULL and empty texts have no words and no hits; NULL or wordless items have no
pattern; repeated rows are scored alike; items that share an id count once; windows of items without an
id hit, but such an item is in no list of items; documents or benchmarks without rows give no rows or no
hits; input columns named like an output are replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, append_from_text, table, written

WINDOW = 10
#: Most characters of benchmark text whose patterns are held by a task at once.
BLOCK_CHARS = 1_000_000
_ADDED = ("n_words", "hit_spans", "items", "contaminated")
_FOUND = "_n_words bigint, _spans array<struct<s:int,e:int>>, _items array<string>"

#: A-Z to a-z; bytes that are in no word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 47 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Finds all occurrences of many patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                b = pattern[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, length), length - end)
            self.bucket[pattern[length - self.block :]].append((list(pattern), items))

    def search(self, words: list[bytes], found: list[tuple[int, int, list]]) -> None:
        length, shift, most = self.length, self.shift.get, self.length - self.block + 1
        i, n, two = length - 1, len(words), self.block == 2
        while i < n:
            b = (words[i - 1], words[i]) if two else (words[i],)
            step = shift(b, most)
            if step:
                i += step
                continue
            start = i - length + 1
            here = words[start : i + 1]
            for pattern, items in self.bucket[b]:
                if pattern == here:
                    found.append((start, i + 1, items))
                    break
            i += 1


def compile_patterns(rows: list[tuple[object, str]], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in rows:
        for pattern in windows_of(words_of((text or "").encode()), window):
            if item not in (own := by_length[len(pattern)][pattern]):
                own.append(item)
    return [WuManber(dict(p), n) for n, p in sorted(by_length.items())]


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"s": s, "e": e} for s, e in out]


def _scan(matchers: list[WuManber], text: bytes) -> tuple[int, list[dict], list[str]]:
    """Words of a text, its hit word ranges and the ids of the items found (items without an id have none)."""
    words, found = words_of(text), []
    for m in matchers:
        m.search(words, found)
    return len(words), _merged([(s, e) for s, e, _ in found]), sorted({i for _, _, ids in found for i in ids if i is not None})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_words, hit_spans (word ranges in windows of the benchmark), items and contaminated."""
    own, bench = Own(docs), Own(benchmark)
    mine = own.kept(_ADDED, keep)
    items = bench.df.select(F.col(bench[item_id]).cast("string").alias("_item"), F.col(bench["text"]).alias("_t")).where("_t is not null")
    total = items.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    rows, drop = own.df.select(*dict.fromkeys([*mine, own[text]])), own[text] not in mine
    found = _pass(rows, own[text], items, window, drop) if blocks == 1 else _passes(rows, own[text], items, window, blocks)
    return own.back(found, {"n_words": "_n_words", "hit_spans": "_spans", "items": "_items", "contaminated": F.size("_spans") > 0}, keep)


def _pass(rows: DataFrame, text: str, items: DataFrame, window: int, drop: bool) -> DataFrame:
    """rows (drop: without their text) with _n_words, _spans and _items by the patterns of items, which one broadcast holds."""
    shared = rows.sparkSession.sparkContext.broadcast([(r._item, r._t) for r in items.toLocalIterator()])
    compiled: list = []

    def search(texts: list[bytes]) -> dict:
        if not compiled:
            compiled.append(compile_patterns(shared.value, window))
        got = [_scan(compiled[0], x) for x in texts]
        return {"_n_words": [n for n, _, _ in got], "_spans": [s for _, s, _ in got], "_items": [i for _, _, i in got]}

    return append_from_text(rows, _FOUND, search, text, drop=drop)


def _passes(rows: DataFrame, text: str, items: DataFrame, window: int, blocks: int) -> DataFrame:
    """As _pass, by blocks of patterns: separate tasks read the texts for each block, and hits meet by row."""
    base = written(append_from_text(rows.withColumn("_row", F.monotonically_increasing_id()), "_n_words bigint", lambda x: {"_n_words": [len(words_of(y)) for y in x]}, text), "texts")
    hits = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_item", "_t"), F.lit(blocks)) == k)
        some = _pass(base.select("_row", text), text, part, window, True).where(F.size("_spans") > 0).select("_row", "_spans", "_items")
        hits = some if hits is None else hits.unionByName(some)
    both = hits.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    def merge(batches):
        import pyarrow as pa

        for batch in batches:
            spans = [_merged([(x["s"], x["e"]) for x in own]) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type), batch.column(2)], names=["_of", "_spans", "_items"])

    merged = both.mapInArrow(merge, "_of bigint, _spans array<struct<s:int,e:int>>, _items array<string>")
    joined = base.join(merged, F.col("_row") == F.col("_of"), "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("_spans", "_items")})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
with tok as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
pat as (
  select distinct item_id, least(len(w), 10) k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') p
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0)),
win as (
  select doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') p
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) s from tok, (select distinct k from pat) where len(w) >= k)),
hit as (select doc_id, s, win.k, item_id from win join pat on win.k = pat.k and win.p = pat.p),
cov as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(s, s + k)) j from hit) group by doc_id),
its as (select doc_id, count(i) n, string_agg(i, ',' order by i) ids from (select distinct doc_id, item_id::varchar i from hit) group by doc_id)
select tok.doc_id, len(w)::bigint n_words, coalesce(cov.n, 0)::bigint n_hit, coalesce(its.n, 0)::bigint n_items,
       sha256(coalesce(its.ids, '')) items_sha256, coalesce(cov.n, 0) > 0 contaminated
from tok left join cov using (doc_id) left join its using (doc_id)
"""
