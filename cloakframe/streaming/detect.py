"""The stateless transforms on streams, and pseudonyms by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions.patterns import ALL
from cloakframe.operators import mapping as M
from cloakframe.operators.engine import process_text
from cloakframe.sources.files import Files


def process_stream(stream: DataFrame, policies: dict[str, A.Policy] | None = None, text: str = "text", recognizers=ALL, salt: str = "") -> DataFrame:
    """A streaming DataFrame through detection and rewriting; every row stands alone, so no state is kept."""
    return process_text(stream, policies, text, recognizers, salt=salt)


def entity_counts(stream: DataFrame, timestamp: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes", recognizers=ALL) -> DataFrame:
    """Found entities by type and event-time window, with a watermark for late rows."""
    found = process_text(stream.withWatermark(timestamp, late), {"DEFAULT": A.Policy("keep")}, text, recognizers)
    each = found.select(timestamp, F.explode("spans").alias("s")).select(timestamp, F.col("s.entity_type").alias("entity_type"))
    return each.groupBy(F.window(timestamp, window), "entity_type").agg(F.count(F.lit(1)).alias("n"))


def pseudonymize_batches(stream: DataFrame, store_path: str, out_path: str, checkpoint: str):
    """Mint pseudonyms for (entity_type, original, ord) batch by batch.

    The mapping is kept as what each batch added, in a folder of its own below store_path, so a batch writes
    only what is new; one that is tried again reads the batches before it and replaces its own folder.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        earlier = [f"{store_path}/batch={e}" for e in range(epoch) if Files(spark).exists(f"{store_path}/batch={e}/_SUCCESS")]
        before = spark.read.schema(M.SCHEMA).parquet(*earlier) if earlier else M.empty(spark)
        M.mint(batch, before).write.mode("overwrite").parquet(f"{store_path}/batch={epoch}")
        known = spark.read.schema(M.SCHEMA).parquet(*earlier, f"{store_path}/batch={epoch}")
        M.peek(batch, known).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
