"""The models against plain loops: table additions, noisy-or and its gradient, recurrent steps."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import gru, lm, quality, toxicity

from .helpers import texts

SF = "/root/testdata/sf0.001"


def _features(text):
    """quality.FEATURES of a text, word by word and character by character."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), max(len(data), 1)
    count = lambda chars: sum(b in chars for b in data)
    letters = count(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeated = {j for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n), sum(map(len, words)) / n, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(letters, 1), count(b"#*$%&<>@^~_={}[]\\/") / size, count(b"!") / n, count(b"|") / n, count(b"0123456789") / size,
        count(b".,;:") / n, sum(b >= 192 for b in data) / size, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(repeated) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), n / (count(b"\n") + 1), count(b" \t") / n, sum(len(w) > 12 for w in words) / n, sum(len(w) <= 2 for w in words) / n,
    ]


def _gam_score(model, x):
    """The score of one row of features: one table entry per feature, one per pair."""
    bins = [sum(1 for cut in cuts if cut < v) for cuts, v in zip(model.cuts, x, strict=True)]
    z = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]
    return 1 / (1 + math.exp(-z))


def test_op1_equals_table_additions_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    by_id = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    ids = sorted(i for i in by_id if i in y and by_id[i] is not None and zlib.crc32(str(i).encode()) % 5 != 0)
    model = quality.fit(np.array([_features(by_id[i]) for i in ids]), np.array([y[i] for i in ids], float))
    got = quality.op1_quality(spark, SF).collect()
    assert len(got) == len(by_id) and model.pairs
    for r in got:
        want = _gam_score(model, _features(by_id[r.doc_id]))
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.predicted == (want >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_features_of_odd_texts():
    odd = ["", " \n", "a", "A! | b\n\nA! | b\n", "é ÀÉ 12;3 x" * 3, "a b c d e a b c d e", *[t or "" for t in texts(21, 20)]]
    assert np.allclose(quality.features([t.encode() for t in odd]), [_features(t) for t in odd])


def _sentences(text):
    """Words of each sentence of a text: cut at . ! ? and line ends, words of letters, digits and non-ASCII bytes."""
    out, word, sentence = [], b"", []
    for b in (text or "").encode() + b"\n":
        if chr(b).isalnum() and b < 128 or b > 127:
            word += bytes([b]).lower() if b < 128 else bytes([b])
            continue
        if word:
            sentence.append(word)
            word = b""
        if b in b".!?\n\r" and sentence:
            out.append(sentence)
            sentence = []
    return out


def _word_keys(word):
    """The features of a word: itself, and its prefixes of the lengths below its own."""
    t = toxicity.Tokens([word])
    return [int(h) for at, hs in t.features() for h in hs]


def _noisy_or(model, text):
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    p_none, each = 1.0, []
    for sentence in _sentences(text):
        z = model.bias + sum(weights.get(k, 0.0) for w in sentence for k in _word_keys(w))
        each.append(1 / (1 + math.exp(-z)))
        p_none *= 1 - each[-1]
    return 1 - p_none, each


def test_op4_equals_noisy_or_sentence_by_sentence(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    by_id = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    ids = sorted(i for i in by_id if i in y and by_id[i] is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    model = toxicity.fit([by_id[i].encode() for i in ids], [y[i] for i in ids])
    assert len(model.keys)
    got = toxicity.op4_toxicity(spark, SF).collect()
    assert len(got) == len(by_id)
    for r in sorted(got, key=lambda r: len(by_id[r.doc_id] or ""))[:150]:
        want, each = _noisy_or(model, by_id[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == (r.score >= 0.3)
        assert r.n_offending == sum(p >= 0.3 for p in each) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op4_fit_follows_the_gradient():
    """More steps lower the documents' loss, and the first goes against the loss's differences in each weight."""
    rng = np.random.default_rng(6)
    bad, good = [f"vile{i}" for i in range(6)], [f"calm{i}" for i in range(40)]
    texts, y = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(good, 6)) for _ in range(rng.integers(1, 5))]
        if i % 3 == 0:
            sentences.insert(int(rng.integers(len(sentences) + 1)), f"{rng.choice(good)} {rng.choice(bad)} {rng.choice(good)}")
        texts.append(". ".join(sentences).encode())
        y.append(int(i % 3 == 0))

    def loss(model):
        p = np.clip(model.score(texts)[0], 1e-12, 1 - 1e-12)
        t = np.array(y)
        return float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())

    early, late = toxicity.fit(texts, y, steps=5), toxicity.fit(texts, y, steps=150)
    assert loss(late) < loss(early) and loss(late) < 0.2
    # differences of the loss in the bias and in each weight point the way the first steps went
    start = toxicity.fit(texts, y, steps=0)
    one = toxicity.fit(texts, y, steps=1)
    for at in range(min(8, len(start.weights))):
        step = np.zeros(len(start.weights))
        step[at] = 1e-5
        slope = (loss(toxicity.Model(start.keys, start.weights + step, start.bias)) - loss(toxicity.Model(start.keys, start.weights - step, start.bias))) / 2e-5
        moved = one.weights[at] - start.weights[at]
        assert abs(slope + 1e-5 * start.weights[at]) < 1e-8 or slope * moved < 0
    slope = (loss(toxicity.Model(start.keys, start.weights, start.bias + 1e-5)) - loss(toxicity.Model(start.keys, start.weights, start.bias - 1e-5))) / 2e-5
    assert slope * (one.bias - start.bias) < 0


def _plain_score(p, vocab, counts, text):
    """log10 probability of a text, one token at a time with scalar arithmetic."""
    hidden = p["U"].shape[0]
    size = p["W"].shape[2]
    h, previous, total = [0.0] * hidden, vocab.end, 0.0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    tail_tokens, tail_words = Counter(), Counter()
    own = set(vocab.words[: lm.WORDS])
    for word, c in counts.items():
        if word not in own:
            tail_tokens[lm.tail_of(word)] += c
            tail_words[lm.tail_of(word)] += 1
    for word in lm.tokens((text or "").encode()):
        x = p["E"][previous].astype(float)
        u = [sum(h[i] * float(p["U"][i, k]) for i in range(hidden)) for k in range(3 * hidden)]
        z = [sigmoid(x[k] + u[k]) for k in range(hidden)]
        r = [sigmoid(x[hidden + k] + u[hidden + k]) for k in range(hidden)]
        m = [math.tanh(x[2 * hidden + k] + r[k] * u[2 * hidden + k]) for k in range(hidden)]
        h = [z[k] * h[k] + (1 - z[k]) * m[k] for k in range(hidden)]
        logits = [float(p["c"][k]) + sum(h[i] * float(p["C"][i, k]) for i in range(hidden)) for k in range(p["c"].shape[0])]
        norm = math.log(sum(map(math.exp, logits)))
        token = vocab.words.index(word) if word in own else lm.WORDS + lm.tail_of(word)
        if token < lm.WORDS:
            of, at = divmod(token, size)
            inner = [float(p["w"][of, k]) + sum(h[i] * float(p["W"][of, i, k]) for i in range(hidden)) for k in range(size)]
            total += (logits[of] - norm + inner[at] - math.log(sum(map(math.exp, inner)))) / math.log(10)
        else:
            tail = token - lm.WORDS
            total += (logits[lm.CLASSES + tail] - norm) / math.log(10)
            total += math.log10((counts.get(word, 0) + 1) / (tail_tokens[tail] + tail_words[tail] + 1))
        previous = token
    return total


def _trained(spark, docs):
    train = docs.where(~lm.in_fold(F.col("doc_id"), lm.FOLDS, lm.HELD_OUT))
    counts = lm.written(lm.token_counts(train), "counts")
    vocab = lm.vocabulary(counts)
    return counts, vocab, lm.train(train, vocab, shard_tokens=400)


def test_op3_score_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (60,))  # some words are rare
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % (3 + i)}" for k in range(i % 23)) if i % 9 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, vocab, p = _trained(spark, docs)
    by_word = {r.word.encode(): r.c for r in counts.collect()}
    got = {r.doc_id: r for r in lm.score_documents(docs, counts, vocab, p).collect()}
    for i, t in rows:
        assert got[i].score == pytest.approx(_plain_score(p, vocab, by_word, t), abs=1e-4 * got[i].n_tokens)


def test_op3_does_not_depend_on_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    scores = []
    for parts in (1, 6):
        spread = docs.repartition(parts, "text")
        counts, vocab, p = _trained(spark, spread)
        scores.append({r.doc_id: (r.score, r.n_tokens) for r in lm.score_documents(spread, counts, vocab, p, ["doc_id"]).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(scores[0][i][0] - scores[1][i][0]) <= 1e-6 * scores[0][i][1] for i in scores[0])


def test_weights_average_by_tokens(spark):
    rows = [(0, s, float(n), [float(s), 1.0]) for s, n in ((2, 1), (0, 3), (1, 4))]
    got = lm._average(spark.createDataFrame(rows, "chunk int, shard int, n double, w array<float>"), "chunk").first()
    assert got.n == 8 and list(got.w) == [(2 * 1 + 0 * 3 + 1 * 4) / 8, 1.0]
    assert gru.HIDDEN == 16


_ODD_TEXTS = [b"", b" ", b"\n Ab\x0b\x0ccD\r\t", "É  x \u0085 ab aB".encode(), b"a", b"ab q ab \x1c z9 q", b"\x00 a\x00 "]


def test_cut_equals_tokens():
    for texts in (_ODD_TEXTS, [b""], [b" a "], [b"a"] * 3):
        c = lm.cut(texts)
        words = c.words.to_pylist()
        assert [[words[i] for i in x] for x in np.split(c.at, c.ends)[:-1]] == [lm.tokens(x) for x in texts] and len(c.at) == c.ends[-1]
        used = [i for i, w in enumerate(words) if w]
        assert lm.tails_of(c.words)[used].tolist() == [lm.tail_of(words[i]) for i in used]


@pytest.mark.parametrize("known", [[], [b"ab", b"\n"], [b"\n", b"ab", b"a", b"q"]])
def test_texts_are_read_as_word_by_word(known, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 2)
    vocab = lm.Vocabulary(known, np.arange(len(known), 0, -1.0), 9, 9, np.arange(lm.TAILS) + 1.0, np.ones(lm.TAILS))
    got = lm._read_texts(_ODD_TEXTS, vocab)
    for i, text in enumerate(_ODD_TEXTS):
        words = lm.tokens(text)
        places = [known.index(w) if w in known else -1 for w in words]
        ids = [p if 0 <= p < 2 else 2 + lm.tail_of(w) for p, w in zip(places, words, strict=True)]
        logs = [math.log10(len(known) - p + 1) if p >= 0 else 0 for p in places]
        assert np.frombuffer(got["_ids"][i].as_py(), np.uint16).tolist() == ids and got["_n"][i] == len(words) and got["_known"][i] == sum(p >= 0 for p in places)
        assert got["_base"][i] == pytest.approx(sum(logs))
        assert got["_inner"][i] == pytest.approx(sum(x for x, p in zip(logs, places, strict=True) if p >= 2) + sum(vocab.tail_log[k - 2] for k in ids if k >= 2))
        assert {r["word"].encode(): r["n"] for r in got["_rare"][i].as_py()} == Counter(w for w, p in zip(words, places, strict=True) if p < 0)


def test_large_logits_do_not_overflow():
    p = gru.start(8, 2, 2, np.ones(10), hidden=4)
    h, ids = np.tile(np.float32([[1, -1, 1, -1]]), (10, 1)), np.arange(10)
    p["C"] *= 1e5
    p["W"] *= 1e5
    got = gru.token_log_probs(p, h, ids)
    logs = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    of = logs(h[0].astype(float) @ p["C"].astype(float) + p["c"])
    want = [of[i // 4] + logs(h[0].astype(float) @ p["W"][i // 4].astype(float) + p["w"][i // 4])[i % 4] if i < 8 else of[i - 6] for i in range(10)]
    near = np.array(want) > -80
    assert near.any() and np.allclose(got[near], np.array(want)[near], rtol=1e-3, atol=1e-2) and not np.isnan(got).any()
