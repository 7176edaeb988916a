"""Blocks: segments joined for detection, and findings projected back onto their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as X
from cloakframe.functions.patterns import ALL
from cloakframe.operators.engine import analyze_rows
from cloakframe.operators.propagate import candidates, merge_mentions, seeds_from, with_mentions
from cloakframe.operators.roles import ROLE_TYPES, drop_role_terms, is_role_term, terms_in
from cloakframe.sources.scratch import written

MIN_FRAGMENT_WORD = 3


def run_block(segment_id: Column) -> Column:
    """The block of a run id (…/r3, …/n2): what stands before; NULL for others."""
    return F.when(segment_id.rlike("/[rn][0-9]+$"), F.regexp_replace(segment_id, "/[rn][0-9]+$", ""))


def join_blocks(segments: DataFrame) -> DataFrame:
    """(doc_id, block_ord, text, segs) from (doc_id, seg_ord, segment_id, text, block, join_before).

    Segments of one block key join in document order, adjacent or not; those without one stand alone.
    join_before stands between segments only.  segs: segment_id, offset, text.
    """
    key = F.coalesce(F.concat(F.lit("b:"), F.col("block")), F.concat(F.lit("s:"), F.col("seg_ord").cast("string")))
    own = F.struct("seg_ord", "segment_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("join_before", F.lit("")).alias("join"))
    grouped = segments.groupBy("doc_id", key.alias("_key")).agg(F.array_sort(F.collect_list(own)).alias("_segs"))
    parts = F.transform("_segs", lambda s, i: F.when(i == 0, s["text"]).otherwise(F.concat(s["join"], s["text"])))
    ends = X.running_sums(F.transform(parts, F.length))
    placed = F.transform(F.arrays_zip(F.col("_segs").alias("s"), ends.alias("e")), lambda x: F.struct(x["s"]["segment_id"].alias("segment_id"), (x["e"] - F.length(x["s"]["text"])).alias("offset"), x["s"]["text"].alias("text")))
    return grouped.select("doc_id", F.get("_segs", F.lit(0))["seg_ord"].alias("block_ord"), F.array_join(parts, "").alias("text"), placed.alias("segs"))


def pieces_of(segs: Column, start: Column, end: Column) -> Column:
    """The parts of a span inside each segment: segment_id, start, end, text."""
    cut = F.transform(segs, lambda g: F.struct(g["segment_id"].alias("segment_id"), (F.greatest(start, g["offset"]) - g["offset"]).alias("start"), (F.least(end, g["offset"] + F.length(g["text"])) - g["offset"]).alias("end"), g["text"].alias("text")))
    return F.transform(F.filter(cut, lambda p: p["start"] < p["end"]), lambda p: F.struct(p["segment_id"].alias("segment_id"), p["start"].alias("start"), p["end"].alias("end"), F.substring(p["text"], p["start"] + 1, p["end"] - p["start"]).alias("text")))


def fragment_words(piece: Column, original: Column) -> Column:
    """Words of three characters or more of a piece that are whole words of the finding, in order."""
    whole = X.words(original)
    return F.array_distinct(F.filter(X.words(piece), lambda w: (F.length(w) >= MIN_FRAGMENT_WORD) & F.array_contains(whole, w)))


def detect_blocks(segments: DataFrame, recognizers=ALL, threshold: float | None = None, entities: list[str] | None = None) -> DataFrame:
    """Findings (doc_id, block_ord, start, end, entity_type, score, original, pieces) of documents of segments.

    Terms defined in any block are roles in all, and names found in any block are looked for in every
    block.  Blocks are detected once, into a written table that the document-wide passes read; where no
    name can be found there is nothing to look for, and nothing is written.
    """
    blocks = join_blocks(segments).where(X.strip(F.col("text")) != "")
    spans = analyze_rows(blocks, "text", recognizers, threshold, entities)
    final = spans
    if {r.entity_type for r in recognizers} & set(ROLE_TYPES if entities is None else entities) & set(ROLE_TYPES):
        read = written(spans.withColumn("_terms", terms_in(F.col("text"))), "blocks")
        terms = read.select("doc_id", F.explode("_terms").alias("t")).groupBy("doc_id").agg(F.array_sort(F.collect_set("t")).alias("defined"))
        kept = read.drop("_terms").join(terms, "doc_id", "left").withColumn("spans", drop_role_terms(F.col("spans"), F.col("defined")))
        offered = kept.select("doc_id", "block_ord", candidates(F.col("spans")).alias("c")).where(F.size("c") > 0)
        ordered = offered.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "c"))), lambda x: x["c"])).alias("c"))
        seeds = ordered.select("doc_id", seeds_from(F.col("c")).alias("_seeds"))
        both = with_mentions(kept.join(seeds, "doc_id", "left"))
        added = F.filter("_mentions", lambda m: ~is_role_term(m["entity_type"], F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]), F.col("defined")))
        final = both.withColumn("spans", merge_mentions("text", F.col("spans"), added))
    each = final.select("doc_id", "block_ord", "segs", F.explode("spans").alias("s"))
    found = each.select("doc_id", "block_ord", "s.start", "s.end", "s.entity_type", "s.score", F.col("s.text_span").alias("original"), pieces_of(F.col("segs"), F.col("s.start"), F.col("s.end")).alias("pieces"))
    return found.where(F.size("pieces") > 0)
