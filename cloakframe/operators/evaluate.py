"""Detection quality: predictions against annotations, by entity type."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.functions import text as X


def _exact(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    keys = ["doc_id", "entity_type", "start", "end"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy("start")).alias("_n")
    t, p = truth.select(*keys, n), predicted.select(*keys, n)
    both = t.withColumn("_t", F.lit(1)).join(p.withColumn("_p", F.lit(1)), [*keys, "_n"], "full")
    return both.groupBy("doc_id", "entity_type").agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    truth = pdf[pdf["is_truth"]].sort_values(["start", "end"])[["start", "end"]].to_numpy().tolist()
    found = pdf[~pdf["is_truth"]].sort_values("score", ascending=False, kind="stable")
    tp, free = 0, list(truth)
    for s, e in found[["start", "end"]].to_numpy().tolist():
        at = next((i for i, (a, b) in enumerate(free) if s < b and a < e), None)
        if at is not None:
            free.pop(at)
            tp += 1
    return pd.DataFrame({"doc_id": [str(pdf["doc_id"].iloc[0])], "entity_type": [pdf["entity_type"].iloc[0]], "tp": [tp], "fp": [len(found) - tp], "fn": [len(free)]})


def counts(truth: DataFrame, predicted: DataFrame, mode: str = "exact") -> DataFrame:
    """(doc_id, entity_type, tp, fp, fn); exact: equal offsets; overlap: best score first, any shared character."""
    if mode == "exact":
        return _exact(truth, predicted)
    cols = ["doc_id", "entity_type", "start", "end", "score", "is_truth"]
    t = truth.withColumn("score", F.lit(1.0)).withColumn("is_truth", F.lit(True)).select(*cols)
    p = predicted.withColumn("is_truth", F.lit(False)).select(*cols)
    both = t.unionByName(p).withColumn("doc_id", F.col("doc_id").cast("string"))
    return both.groupBy("doc_id", "entity_type").applyInPandas(_greedy, "doc_id string, entity_type string, tp long, fp long, fn long")


def metrics(counted: DataFrame, *keys: str) -> DataFrame:
    """Sums by keys with precision, recall and f1; 0/0 is 0.0."""
    sums = counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(by_type: DataFrame) -> DataFrame:
    """Unweighted means over the types; counts are sums."""
    return by_type.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def annotated_texts(parts: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, text, entities) from parts (doc_id, ord, text, entity_type: NULL for plain text) in the order of ord.

    entities: start, end, entity_type, text and a context of up to width characters on either side.
    """
    own = F.struct("ord", "text", "entity_type")
    grouped = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("_parts"))
    whole = grouped.withColumn("text", F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    sizes = F.transform("_parts", lambda p: F.coalesce(F.length(p["text"]), F.lit(0)))
    placed = F.transform(F.arrays_zip(F.col("_parts").alias("p"), X.running_sums(sizes).alias("e")), lambda x: F.struct((x["e"] - F.coalesce(F.length(x["p"]["text"]), F.lit(0))).alias("start"), x["e"].alias("end"), x["p"]["entity_type"].alias("entity_type")))
    named = F.filter(placed, lambda s: s["entity_type"].isNotNull())

    def described(cut) -> Column:
        return F.transform(named, lambda s: F.struct(s["start"], s["end"], s["entity_type"], cut(s["start"], s["end"]).alias("text"), cut(*X.around(s["start"], s["end"], width)).alias("context")))

    return whole.select("doc_id", "text", X.cutting("text", described).alias("entities"))
