"""Mixing against SQL and its own promises; the pipeline against a brute-force version."""

import math

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cloakframe.llm import decontam, line_dedup, mixing, toxicity

from .helpers import fingerprint, groups

SF = "/root/testdata/sf0.001"


def _docs(n=300):
    out = []
    for i in range(n):
        source = ["big", "mid", "small", None][0 if i % 2 else 1 if i % 3 else 2 if i % 5 else 3]
        out.append((i, source, " ".join(["w"] * (i % 17)) if i % 11 else None))
    return [*out, out[7], (None, "mid", "a b c")]


def _key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_mix_equals_sql(spark):
    docs = pd.DataFrame(_docs(), columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame(_docs(), "doc_id long, source string, text string")
    columns = ["doc_id", "source", "n_tokens", "epoch", "block", "block_order", "doc_order"]
    want = duckdb.sql(mixing.mix_sql("docs")).fetchall() if docs is not None else []
    got = mixing.mix(df).select(*columns).collect()
    assert _key(got) == _key(want)


def test_weights_budget_and_limits(spark):
    df = spark.createDataFrame([(*r, 1) for r in _docs()], "doc_id long, source string, text string, epoch int")
    total = sum(len((t or "").split()) for _, _, t in _docs())
    drawn = mixing.mix(df, target_entropy=0.99, max_repeats=8.0, block_tokens=20).toPandas()
    by = drawn.groupby("source", dropna=False)["n_tokens"].sum()
    assert by.sum() <= total and by.sum() > total - 4 * 40
    shares = by / by.sum()
    assert -(shares * shares.map(math.log)).sum() >= 0.98 * math.log(4)
    full = mixing.mix(df, max_repeats=1.0).toPandas()
    assert full["epoch"].max() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.withColumn("text", df["source"].substr(1, 0))).count() == 0
    one = mixing.mix(df.where("source = 'big'"))
    assert one.count() == df.where("source = 'big'").count()


def test_no_document_is_lost_at_exponent_one(spark):
    """Twenty equal sources and a hot one: at exponent 1 each is drawn exactly once, however rows are spread."""
    import random

    docs = [(i, f"s{i % 20}", " ".join(["w"] * (1 + i // 20 % 9))) for i in range(400)]
    for rows in (docs, [*docs, *[(1000 + i, "hot", "w " * (i % 13)) for i in range(700)]]):
        want = sorted(i for i, _, t in rows if t.split())
        for parts, seed in [(k, k) for k in range(1, 9)]:
            some = list(rows)
            random.Random(seed).shuffle(some)
            df = spark.createDataFrame(some, "doc_id long, source string, text string").repartition(parts)
            got = mixing.mix(df, target_entropy=0.1, max_repeats=1000.0).where("n_tokens > 0")
            assert sorted(r.doc_id for r in got.collect()) == want


def test_draws_do_not_depend_on_layout_and_fill_the_budget(spark):
    df = spark.createDataFrame(_docs(), "doc_id long, source string, text string")
    sums = df.groupBy(df.source.alias("_source")).agg(mixing.F.sum(mixing.F.coalesce(mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD)), mixing.F.lit(0))).cast("long").alias("_tokens"))
    for budget in (None, 1, 997, 12_345):
        got = mixing.quotas(sums, budget=budget).agg({"_quota": "sum", "_tokens": "sum"}).first()
        assert got["sum(_quota)"] == (got["sum(_tokens)"] if budget is None else budget)
    key = lambda parts: _key(mixing.mix(df.repartition(parts, "text")).collect())
    assert key(1) == key(3) == key(8)


@pytest.fixture(scope="module")
def expected():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create table {t} as select * from '{SF}/{t}.parquet'")
    rows = con.sql("select doc_id, text, toxic from documents join labels using (doc_id) where toxic is not null").fetchall()
    import zlib

    fit_on = [(t.encode(), y) for i, t, y in sorted(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = toxicity.fit([t for t, _ in fit_on], [y for _, y in fit_on])
    docs = con.sql("select * from documents order by doc_id").df()
    p = model.score([t.encode() for t in docs["text"]])[0]
    docs = docs[p < toxicity.THRESHOLD]
    con.sql("create or replace table documents as select * from docs")
    lines = con.sql(line_dedup.OP8_SQL).df()[["doc_id", "text", "n_removed"]]
    docs = docs.drop(columns="text").merge(lines, on="doc_id")
    docs.loc[docs["n_removed"] > 0, "n_chars"] = docs["text"].str.len()
    f = {i: fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    stays = set(groups(list(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 3).values())
    docs = docs[docs["doc_id"].isin(stays)]
    con.sql("create or replace table documents as select * from docs")
    bad = con.sql(decontam.OP2_SQL).df()
    docs = docs[~docs["doc_id"].isin(bad[bad["contaminated"]]["doc_id"])]
    con.sql("create or replace table documents as select * from docs")
    return con.sql(mixing.mix_sql("documents", "doc_id, source, n_chars, md5(text) as text")).fetchall()


def test_pipeline_equals_brute_force(spark, expected):
    from pyspark.sql import functions as F

    got = corpus_pipeline.run(spark, SF)
    own = got.select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")), "n_tokens", "epoch", "block", "block_order", "doc_order").collect()
    assert _key(own) == _key(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
