"""Quality, toxicity and language models: held-out accuracy, exact base counts, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from cloakframe.llm import gru, lm, quality, toxicity

from .helpers import rows

DATA = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"


def _labelled(label, parts, out):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    y = dict(zip(*pq.read_table(f"{DATA}/labels.parquet", columns=["doc_id", label]).to_pydict().values(), strict=True))
    own = [(i, x.encode(), y[i]) for i, x in zip(*t.to_pydict().values(), strict=True) if i in y]
    held = lambda i: zlib.crc32(str(i).encode()) % parts == out
    return [x for x in own if not held(x[0])], [x for x in own if held(x[0])]


def test_quality_held_out():
    fit_on, test = _labelled("quality", 5, 0)
    model = quality.fit(quality.features([x[1] for x in fit_on]), np.array([x[2] for x in fit_on], float))
    predicted = model.score(quality.features([x[1] for x in test])) >= quality.THRESHOLD
    truth = np.array([x[2] for x in test], bool)
    assert (predicted == truth).mean() > 0.98 and predicted[truth].mean() > 0.99 and model.pairs


def test_quality_edges():
    x = quality.features([b"", b" \n", b"one", b"w " * 50_000])
    assert x.shape == (4, len(quality.FEATURES)) and not x[:2].any() and np.isfinite(x).all()
    assert np.allclose(quality.fit(x, np.ones(4)).score(x), 0.9)
    assert quality.fit(x[:0], np.zeros(0)).score(x)[0] == 0.5


def test_toxicity_held_out_and_located():
    fit_on, test = _labelled("toxic", 4, 2)
    model = toxicity.fit([x[1] for x in fit_on], [x[2] for x in fit_on])
    predicted = model.score([x[1] for x in test])[0] >= toxicity.THRESHOLD
    truth = np.array([x[2] for x in test], bool)
    assert predicted[truth].mean() > 0.85 and predicted[~truth].mean() < 0.02
    text = b"A calm line here. You are an idiot and a moron! And one more line."
    p, tokens, each = model.score([text])
    worst = int(np.argmax(each))
    assert p[0] > 0.5 and b"idiot" in tokens.words.data[tokens.start[worst] : tokens.end[worst]]


def test_toxicity_edges(spark):
    assert toxicity.fit([b"a b"], [0]).score([b"", b"a"])[0].max() < 1e-9
    df = spark.createDataFrame([(*d, 5) for d in rows(1, 5)] + [(None, "x", 5)], DOCS + ", score int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (999, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.train(df, labels))
    assert got.count() == 11 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.train(df, labels.limit(0)).score([b"a"])[0][0] < 1e-9


def test_gru_gradient_and_carried_state():
    rng = np.random.default_rng(3)
    p = gru.start(8, 2, 2, np.ones(10), hidden=4)
    ids = rng.integers(0, 10, 400).astype(np.int32)
    before = gru.score(p, [ids], end=9)[0]
    for _ in range(5):
        gru.train(p, ids, 9, rate=0.01, streams=4, window=8)
    assert gru.score(p, [ids], end=9)[0] > before
    texts = [ids[:7], ids[:350], ids[:1]]
    whole = gru.score(p, texts, 9, window=1000)
    assert np.allclose(gru.score(p, texts, 9, group=2, window=16), whole, rtol=1e-4)
    h = np.zeros((1, 4), np.float32)  # all probabilities of a step sum to one
    h = gru._step(p, p["E"][[3]], h)[0]
    assert abs(np.exp(gru.token_log_probs(p, np.repeat(h, 10, 0), np.arange(10))).sum() - 1) < 1e-5


def test_gru_trains_on_every_token():
    """The loss before the first update is that of all tokens, also those that don't fill a row of streams."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 9, 131, 403):
        ids = rng.integers(0, 9, size).astype(np.int32)
        for streams in (1, 3, 8):
            p = gru.start(8, 2, 2, np.ones(10), hidden=4)
            p["C"] *= 100  # tokens differ in loss
            p["E"] *= 10
            still = {k: v.copy() for k, v in p.items()}
            loss = gru.train(p, ids, 9, rate=0.0, streams=streams, window=8)
            used = max(1, min(streams, size // 32 or 1))
            length = -(-size // used)
            want = 0.0
            for lo in range(0, size, length):  # each stream starts from a zero state, with the token before it
                h, prev = np.zeros((1, 4), np.float32), ids[lo - 1] if lo else 9
                for x in ids[lo : lo + length]:
                    h = gru._step(still, still["E"][[prev]], h * (prev != 9))[0]
                    want -= gru.token_log_probs(still, h, np.array([x]))[0]
                    prev = x
            assert abs(loss - want / size) < 1e-4
    p = gru.start(8, 2, 2, np.ones(10), hidden=4)
    ids = np.append(np.zeros(66, np.int32), np.int32(7))  # one token more than two streams hold evenly
    before = p["w"].copy()
    gru.train(p, ids, 9, streams=2, window=8)
    assert p["w"][1, 3] > before[1, 3]  # the last token was a target


def _score(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    from pyspark.sql import functions as F

    train = df.where(~lm.in_fold(F.col("doc_id"), 7, 2))
    counts = lm.written(lm.token_counts(train), "counts")
    vocab = lm.vocabulary(counts)
    return {r.doc_id: r for r in lm.score_documents(df, counts, vocab, lm.train(train, vocab), ["doc_id"]).collect()}


def test_lm_base_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (4,))  # most words are rare
    docs = rows(2, 40)
    got = _score(spark, docs)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in docs}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
        assert r.score < 0


def test_warm_texts_are_repeatable_and_grow(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text "), F.col("id").cast("string")).alias("text"))
    pick = lambda df, share: [bytes(r._t) for r in lm.warm_texts(df, df.count(), least=50, share=share).collect()]
    one = pick(docs.repartition(1), 100)
    assert one == pick(docs.repartition(7, "text"), 100) == pick(docs.orderBy(F.desc("doc_id")), 100)
    assert 150 < len(one) < 250 and 70 < len(pick(docs.where("doc_id < 10000"), 100)) < 130
    assert 25 < len(pick(docs, 10_000)) < 80 and len(pick(docs.limit(40), 100)) == 40
    assert len(pick(docs.withColumn("doc_id", F.lit(None).cast("long")), 100)) > 150  # rows without an id, by their text


def test_first_weights_do_not_depend_on_layout(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("string")) for i in range(40)]).alias("text"))
    vocab = lm.vocabulary(lm.written(lm.token_counts(docs), "counts"))
    seen = []
    real = lm.gru.train
    monkeypatch.setattr(lm.gru, "train", lambda p, ids, *a, **k: (seen.append(ids.copy()), real(p, ids, *a, **k))[1])
    lm.train(docs.repartition(1), vocab)
    lm.train(docs.repartition(5, "text"), vocab)
    assert len(seen) == 4 and np.array_equal(seen[0], seen[2])


def test_lm_without_rows(spark):
    assert _score(spark, []) == {}


def test_lm_held_out_beats_base(spark):
    from pyspark.sql import functions as F

    scored = lm.op3_language_model(spark, "/root/testdata/sf0.01").where("held_out")
    r = scored.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert r[0] > r[1] + 0.1 and r[2] > 0.95
