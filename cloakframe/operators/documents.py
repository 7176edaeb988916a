"""Documents of segments end to end: detect over blocks, rewrite, write back, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions import text as X
from cloakframe.functions.patterns import ALL
from cloakframe.operators.blocks import detect_blocks, fragment_words
from cloakframe.operators.leak import verify
from cloakframe.sources import office


def rewrite_segments(segments: DataFrame, findings: DataFrame, policies: dict[str, A.Policy] | None = None, salt: str = "", default: A.Policy = A.HIPS) -> tuple[DataFrame, DataFrame]:
    """(segments with findings rewritten and their originals, (doc_id, original) to verify).

    The first piece of a finding carries its replacement, the others become empty.  Surrogates avoid
    every original of the document, whatever becomes of it.
    """
    parts = F.flatten(F.transform("pieces", lambda p: fragment_words(p["text"], F.col("original"))))
    extra = F.when(F.size("pieces") > 1, parts).otherwise(F.array().cast("array<string>"))
    named = findings.withColumn("_all", F.array_distinct(F.concat(F.array("original"), extra)))
    context = named.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("_avoid"))
    made = named.join(context, "doc_id").withColumn("_avoid", A.avoid_pattern(F.col("_avoid")))
    own_salt = F.sha2(F.concat_ws("|", F.lit(salt), F.col("doc_id").cast("string")).cast("binary"), 256)
    made = made.withColumn("_new", A.render(F.col("entity_type"), F.col("original"), policies, own_salt, F.col("_avoid"), default))
    made = made.withColumn("_kept", A.operator_of(F.col("entity_type"), policies, default) == "keep")
    edits = made.select("doc_id", "_all", "_new", "_kept", F.posexplode("pieces").alias("_i", "p")).where("not _kept")
    by_segment = edits.groupBy("doc_id", F.col("p.segment_id").alias("segment_id")).agg(
        F.collect_list(F.struct(F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.when(F.col("_i") == 0, F.col("_new")).otherwise("").alias("replacement"))).alias("_edits"),
        F.array_distinct(F.flatten(F.collect_list("_all"))).alias("originals"),
    )
    out = segments.join(by_segment, ["doc_id", "segment_id"], "left").withColumn("text", F.when(F.col("_edits").isNull(), F.col("text")).otherwise(X.splice("text", F.col("_edits")))).drop("_edits")
    return out, made.where("not _kept").select("doc_id", F.explode("_all").alias("original")).distinct()


def process_documents(files: DataFrame, policies: dict[str, A.Policy] | None = None, recognizers=ALL, threshold: float | None = None, entities: list[str] | None = None, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(files that passed the leak check, quarantine with counts) for (doc_id, format, content)."""
    segments = office.read_segments(files)
    findings = detect_blocks(segments, recognizers, threshold, entities)
    edited, originals = rewrite_segments(segments, findings, policies, salt)
    return verify(office.write_segments(files, edited.where("originals is not null").select("doc_id", "segment_id", "text", "originals")), originals)
