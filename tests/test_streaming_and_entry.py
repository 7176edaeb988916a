"""Streams give what batches give; the driver contract imports with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

from cloakframe.functions import anonymize as A
from cloakframe.functions.patterns import EMAIL
from cloakframe.operators import evaluate as E
from cloakframe.streaming.detect import process_stream, pseudonymize_batches

ROOT = Path(__file__).resolve().parents[1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"mail a{i}@b.com" if i % 2 else "none") for i in range(10)]
    spark.createDataFrame(rows, "doc_id int, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = process_stream(spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in")), {"DEFAULT": A.REPLACE}, recognizers=[EMAIL])
    q = stream.select("doc_id", "anonymized").writeStream.format("memory").queryName("rewritten").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from rewritten").collect())) == [(i, "mail <EMAIL_ADDRESS>" if i % 2 else "none") for i in range(10)]


def test_pseudonym_batches(spark, tmp_path):
    schema = "entity_type string, original string, ord int"
    spark.createDataFrame([("PERSON", f"n{i % 3}", i) for i in range(6)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = pseudonymize_batches(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 6
    spark.createDataFrame([("PERSON", f"n{i}", i) for i in range(5)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = pseudonymize_batches(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    added = spark.read.parquet(str(tmp_path / "store"))  # a batch writes what it adds, nothing again
    assert added.groupBy("batch").count().orderBy("batch").collect()[1]["count"] == 2 and added.select("pseudonym").distinct().count() == 5
    named = spark.read.parquet(str(tmp_path / "out"))
    assert named.count() == 11 and named.select("original", "pseudonym").distinct().count() == 5


def test_overlap_scores(spark):
    truth = spark.createDataFrame([("d", "P", 0, 5), ("d", "P", 10, 15)], "doc_id string, entity_type string, start int, end int")
    found = spark.createDataFrame([("d", "P", 1, 3, 0.9), ("d", "P", 2, 4, 0.8), ("d", "Q", 10, 15, 0.9)], "doc_id string, entity_type string, start int, end int, score double")
    got = {r.entity_type: (r.tp, r.fp, r.fn, r.f1) for r in E.metrics(E.counts(truth, found, "overlap"), "entity_type").collect()}
    assert got == {"P": (1, 1, 1, 0.5), "Q": (0, 1, 0, 0.0)}
    assert E.macro(E.metrics(E.counts(truth, found), "entity_type")).first().tp == 0


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    for name in ("cloakframe", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "cloakframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'email_replace' in e.queries() and not any(q.startswith('op1_') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
