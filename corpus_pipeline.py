"""A training corpus from raw documents: five of the operators in a row.

Each stage takes (spark, docs, sf_dir), with docs read from Parquet, and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontam, line_dedup, mixing, simhash, toxicity
from cloakframe.llm.common import table, written
from cloakframe.sources import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, fitted on labels, doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less lines of three-line windows that occurred before; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws by temperature-mixed source weights; one row per draw."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("mixing", mix)]

#: The fitted model and the fingerprints have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is a written table.

    What a stage wrote on its way, and the table it read, are deleted once its own result is stored.
    """
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch.scope() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        scratch.drop(spark, read + made[:-1])
        read = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
