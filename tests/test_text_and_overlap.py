"""Span offsets, splicing and overlap resolution against plain-Python models."""

import random
import re

from pyspark.sql import functions as F

from cloakframe.functions import text as X
from cloakframe.functions import validators as V
from cloakframe.operators.overlap import normalize_overlaps


def test_spans_equal_finditer(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é😀\n1") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = "[a1]+"
    got = {r.i: [(s.start, s.end, s.text) for s in r.s or []] for r in df.select("i", X.spans_of("t", X.matches("t", pattern), pattern).alias("s")).collect()}
    assert got == {i: [(*m.span(), m[0]) for m in re.finditer(pattern, t or "")] for i, t in enumerate(texts)}


def test_splice_and_whitespace(spark):
    df = spark.createDataFrame([("Ann met Bob", [(0, 3, "X"), (8, 11, "")])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(X.splice("t", F.col("e"))).first()[0] == "X met "
    ws = spark.createDataFrame([("  a \t\n b ",)], "t string")
    assert ws.select(X.normalize_ws("t"), X.strip("t")).first() == ("a b", "a \t\n b")


def _resolve(spans):
    """The pairwise rule, restarted after every change."""
    key = lambda s: (s[0], s[1], -s[2])
    spans = sorted(spans, key=key)
    while True:
        pair = next(((i, j) for i in range(len(spans)) for j in range(i + 1, len(spans)) if spans[j][0] < spans[i][1]), None)
        if pair is None:
            return spans
        a, b = spans[pair[0]], spans[pair[1]]
        if a[0] <= b[0] and b[1] <= a[1]:
            new = [a]
        elif b[0] <= a[0] and a[1] <= b[1]:
            new = [b]
        else:
            first = (a[1] - a[0]) > (b[1] - b[0]) if a[1] - a[0] != b[1] - b[0] else (a[2] > b[2] if a[2] != b[2] else True)
            new = [a, (a[1], b[1], *b[2:])] if first else [(a[0], b[0], *a[2:]), b]
        spans = sorted(spans[: pair[0]] + new + spans[pair[1] + 1 :], key=key)


def test_overlaps_equal_pairwise_model(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        spans = []
        for k in range(rng.randrange(9)):
            s = rng.randrange(20)
            spans.append((s, s + rng.randrange(1, 9), rng.choice([0.4, 0.5, 0.9]), f"T{k}"))
        rows.append((i, spans))
    df = spark.createDataFrame([(i, [dict(start=a, end=b, score=x, entity_type=t, recognizer_name="r") for a, b, x, t in s]) for i, s in rows], "i int, spans array<struct<start:int,end:int,entity_type:string,score:double,recognizer_name:string>>")
    got = {r.i: [(s.start, s.end, s.score) for s in r.out] for r in df.select("i", normalize_overlaps(F.col("spans")).alias("out")).collect()}
    for i, spans in rows:
        assert got[i] == [s[:3] for s in _resolve(spans)], spans


def test_validators(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "1.2.3.255", "1.2.3.256")], "a string, b string, c string, d string, e string, f string")
    assert tuple(df.select(V.luhn(F.col("a")), V.luhn(F.col("b")), V.iban(F.col("c")), V.iban(F.col("d")), V.ipv4(F.col("e")), V.ipv4(F.col("f"))).first()) == (True, False, True, False, True, False)


def test_running_and_cutting(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 100, 1000]))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    for r, (_, v) in zip(df.select("i", X.running_sums(F.col("v")).alias("s"), X.running_max(F.col("v")).alias("m")).orderBy("i").collect(), rows, strict=True):
        assert r.s == [sum(v[: k + 1]) for k in range(len(v))] and r.m == [max(v[: k + 1]) for k in range(len(v))]
    text = "".join(rng.choice("ab😀é\n") for _ in range(5000))
    cuts = [(a, b) for a, b in ((rng.randrange(5001), rng.randrange(5200)) for _ in range(300))] + [(0, 5000), (0, 1024), (1024, 2048), (1023, 1025), (5000, 5001)]
    df = spark.createDataFrame([(text, [dict(s=a, e=b) for a, b in cuts])], "t string, c array<struct<s:int,e:int>>")
    got = df.select(X.cutting("t", lambda cut: F.transform("c", lambda x: cut(x["s"], x["e"])))).first()[0]
    assert got == [text[a:b] for a, b in cuts]


def test_many_spans_in_one_text(spark):
    """Spans, overlaps and splicing of very many matches in one text: right, and not quadratic."""
    import time

    took = []
    for n in (20_000, 40_000):
        text = "é ab1 " * n
        df = spark.createDataFrame([(text,)], "t string")
        began = time.perf_counter()
        spans = X.spans_of("t", X.matches("t", "[a-z]+[0-9]"), "[a-z]+[0-9]")
        full = df.withColumn("s", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("T").alias("entity_type"), F.lit(0.5).alias("score"), F.lit("r").alias("recognizer_name"))))
        out = full.withColumn("s", normalize_overlaps(F.col("s"))).withColumn("e", F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("_").alias("replacement"))))
        r = out.select(F.size("s").alias("n"), X.splice("t", F.col("e")).alias("t")).first()
        took.append(time.perf_counter() - began)
        assert r.n == n and r.t == "é _ " * n
    assert took[1] < 3 * took[0] + 2
