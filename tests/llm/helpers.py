"""Plain-Python models of the operators, for small inputs."""

import random

import xxhash

WORDS = ["a", "b", "c", "é", "dd", "e.", "F"]


def texts(seed, n, longest=40, words=WORDS, newlines=True):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(words) + ("\n" if newlines and rng.random() < 0.2 else "") for _ in range(rng.randrange(longest))) for _ in range(n)]
    return [*out, None, "", " \n ", out[0], "x " * 3000]


def rows(seed, n, **kw):
    return list(enumerate(texts(seed, n, **kw)))


def split(text):
    return (text or "").encode().split()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    """item -> smallest item reachable."""
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(items)
    for x, i in enumerate(items):
        for j in items[x + 1 :]:
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def repeated_words_removed(docs, window):
    """doc_id -> kept words, for documents (doc_id, text)."""
    first, split_docs = {}, {}
    for d, t in docs:
        w = split_docs[d] = split(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in split_docs.items():
        drop = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = [x for j, x in enumerate(w) if j not in drop]
    return out
