"""A bounded, repeatable sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, written

_SLOTS = 1 << 30


def training_labels(labels: DataFrame, label: str, held_out, most_rows: int) -> DataFrame:
    """(_id, _y, _slot) of at most most_rows labelled rows outside the held-out fold; held_out: a function of the id.

    Rows are chosen by a hash of the id, in proportion to what is needed and least hash first, so every
    label has the same chance and the choice is always the same; rows without an id or label are left
    out and an id labelled twice counts once, as 1 if either says so.
    """
    own = Own(labels)
    rows = own.df.select(F.col(own["doc_id"]).alias("_id"), F.col(own[label]).alias("_y")).where("_id is not null and _y is not null")
    rows = rows.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    n = rows.count()
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(_SLOTS)))
    if n > most_rows:
        rows = rows.where(F.col("_slot") < int(_SLOTS * most_rows / n)).orderBy("_slot", "_id").limit(most_rows)
    return rows


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, most_rows: int, most_bytes: int, text: str = "text") -> DataFrame:
    """(_id, _t: whole text, _y, _slot), a written table of the sampled labels' documents, one row per id.

    Of rows that share an id the least text counts; the texts in the order of their hashes add up to
    most_bytes at most.
    """
    own = Own(docs)
    some = training_labels(labels, label, held_out, most_rows)
    texts = own.df.select(F.col(own["doc_id"]).alias("_doc"), F.col(own[text]).alias("_text")).where("_text is not null")
    picked = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id")).groupBy("_id", "_y", "_slot").agg(F.min("_text").alias("_t"))
    picked = written(picked.withColumn("_bytes", F.octet_length("_t")), "labelled")
    # at most most_rows narrow rows
    sums = picked.select("_id", F.sum("_bytes").over(W.orderBy("_slot", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_sum"))
    fits = sums.where(F.col("_sum") <= most_bytes).select(F.col("_id").alias("_fit"))
    return picked.join(F.broadcast(fits), F.col("_id") == F.col("_fit"), "left_semi").select("_id", "_t", "_y", "_slot")
