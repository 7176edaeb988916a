"""Substring, line and near deduplication against plain-Python models."""

import random

import numpy as np
import pytest

from cloakframe.llm import line_dedup, simhash, substring_dedup
from cloakframe.llm.fm_index import FMIndex
from cloakframe.llm.graph import components

from .helpers import fingerprint, groups, repeated_words_removed, rows, split

DOCS = "doc_id long, text string"


def test_fm_index_intervals_and_statistics():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 4, 200)
    text[::37] = 0
    index = FMIndex(text, 4)
    for p in ([1], [2, 3], [1, 2, 3], [3, 3, 3, 3], [1, 2, 1, 2]):
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(p):
            lo, hi = index.extend(np.array([c], np.uint32), lo, hi)
        places = [i for i in range(len(text)) if list(np.concatenate([text, text])[i : i + len(p)]) == p]
        assert max(0, hi[0] - lo[0]) == len(places)
        assert sorted(index.order[lo[0] : hi[0]]) == places
    other = rng.integers(1, 4, 300)
    inside = {tuple(text[i : i + 4]) for i in range(len(text) - 3)}
    found = sorted(int(s) for at, _, _, _ in index.matching(other, np.array([0, 150]), np.array([150, 150])) for s in at)
    want = [i for i in range(300) if (i % 150) <= 146 and tuple(other[i : i + 4]) in inside]
    assert found == want


@pytest.mark.parametrize(("hot", "block"), [(2000, 400_000), (1, 20)])
def test_repeated_windows_go(spark, hot, block):
    docs = rows(6, 60, longest=60)
    want = repeated_words_removed(docs, 4)
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in docs] + [(None, "a b c é dd", "k", 0)], DOCS + ", route string, n_removed int")
    for frame in (df, df.select("doc_id", "text")):
        got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame, window=4, hot_places=hot, block_words=block).collect()}
        assert {k: split(v.text) for k, v in got.items() if k is not None} == want
        assert all(v.n_words - v.n_removed == len(split(v.text)) for v in got.values())
        assert got[None].n_removed == 0 and got[60].text is None


def test_same_id_is_one_document(spark):
    text = "a b c dd e. F"
    df = spark.createDataFrame([(1, text), (1, text), (1, "x " + text), (2, text + " y")], DOCS)
    got = sorted((r.doc_id, r.text) for r in substring_dedup.dedup_substrings(df, window=4).collect())
    assert got == [(1, text), (1, text), (1, "x " + text), (2, "y")]
    assert substring_dedup.dedup_substrings(df.limit(0), window=4).count() == 0


def _lines_left(docs, k=3):
    seen, drop = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        lines = [x for x in (t or "").split("\n") if x.encode().strip()]
        for i in range(len(lines) - k + 1):
            w = tuple(lines[i : i + k])
            if seen.setdefault(w, (d, i)) != (d, i):
                drop.setdefault(d, set()).update(range(i, i + k))
    out = {}
    for d, t in docs:
        kept, i = [], -1
        for x in (t or "").split("\n"):
            if x.encode().strip():
                i += 1
                if i in drop.get(d, ()):
                    continue
            kept.append(x)
        out[d] = None if t is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, "\n".join(rng.choice(["one", "two", "", "three ", " "]) for _ in range(rng.randrange(14)))) for i in range(50)] + [(50, None), (51, ""), (52, "a\n" * 4000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {k: v.text for k, v in got.items()} == _lines_left(docs)
    again = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (None, "q\nr\ns")], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(again).collect()) == [(0, "q\nr\ns"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x")]
    assert line_dedup.dedup_lines(again.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    linked = {frozenset(e) for e in edges}
    nodes = {x for e in edges for x in e}
    want = {n: r for n, r in groups(nodes, lambda a, b: frozenset((a, b)) in linked).items() if n != r}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_list_edges_connect_what_is_linked():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 2**62, 40))
    near = fps[:20] ^ (np.int64(1) << rng.integers(0, 60, 20))
    every = np.unique(np.concatenate([fps, near, near[:10] ^ np.int64(6)]))
    edges = simhash.link_lists(np.zeros(len(every), np.int64), every)
    want = groups(every.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    own = {frozenset(e) for e in edges}
    assert groups(every.tolist(), lambda a, b: frozenset((a, b)) in own) == want and len(edges) == len(every) - len(set(want.values()))


def test_dense_lists_are_parted_without_losing_a_link():
    rng = np.random.default_rng(13)
    for bits, n in ((24, 3000), (10, 900), (4, 16)):
        free = rng.choice(64, bits, replace=False)
        values = rng.choice(1 << bits, n, replace=False)
        fps = np.unique(np.array([sum(1 << int(b) for k, b in enumerate(free) if v >> k & 1) for v in values.tolist()], np.uint64).view(np.int64))
        for limit in (2, 50, 4096):
            cells = list(simhash._cells(fps, limit))
            assert all(len(c) <= max(limit, 8) for c in cells)
            together = {(a, b) for c in cells for i, a in enumerate(sorted(c.tolist())) for b in sorted(c.tolist())[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
            bits_of = fps.view(np.uint64)
            every = {tuple(sorted((int(fps[i]), int(fps[j])))) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(bits_of ^ bits_of[i]) <= 3).tolist() if j != i}
            assert together == every


def test_every_link_shares_an_index_key():
    rng = random.Random(10)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        same = {i for i in range(8) if a >> 8 * i & 255 == b >> 8 * i & 255}
        assert len(same) >= 5 and any(set(t) <= same for t in simhash.TRIPLES) and any(set(t) <= same for t in simhash.FIVES)


@pytest.mark.parametrize("limit", [4096, 2])
def test_near_duplicates_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (limit,))
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(300)}" for _ in range(400)).split()
    docs = rows(12, 15)
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join(w)))
    f = {d: fingerprint(t) for d, t in docs}
    want = groups(list(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 3)
    df = spark.createDataFrame([(*d, "z") for d in docs], DOCS + ", fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {d: (f"{f[d]:016x}", want[d]) for d in f}
    stays = simhash.one_of_each(df.unionByName(df))
    assert stays.columns == df.columns and sorted(r.doc_id for r in stays.collect()) == sorted(set(want.values()))
    none = simhash.near_duplicates(spark.createDataFrame([(None, "a"), (None, "a")], DOCS)).collect()
    assert [r.component_id for r in none] == [None, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
