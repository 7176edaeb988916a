"""A gated recurrent language model in numpy with a class-factored output softmax.

Tokens are ids: ``words`` frequent words in ``classes`` classes of equal size, then ``tails`` ids for
all other words (one per tail class).  P(token) = P(class | state) * P(word | class, state); what a
tail class holds is resolved by the caller.  Training is truncated backpropagation over windows with
the state carried from window to window and reset after the end token.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
WINDOW = 16
STREAMS = 512
SCORE_WINDOW = 64
LEARNING_RATE = 0.008

Params = dict[str, np.ndarray]


def start(words: int, classes: int, tails: int, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Params:
    """Small random weights; the output biases make the untrained model the unigram model of counts."""
    rng = np.random.default_rng(seed)
    size = words // classes
    of_word = (counts[:words] + 1.0).reshape(classes, size)
    of_class = np.append(of_word.sum(1), counts[words:] + 1.0)
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "E": draw(words + tails, 3 * hidden),
        "U": draw(hidden, 3 * hidden) * 3,
        "C": draw(hidden, classes + tails) * 0.1,
        "c": np.log(of_class / of_class.sum()).astype(np.float32),
        "W": draw(classes, hidden, size) * 0.1,
        "w": np.log(of_word / of_word.sum(1, keepdims=True)).astype(np.float32),
    }


def _step(p: Params, x: np.ndarray, h: np.ndarray):
    """The next state, both gates, the candidate and its recurrent part; temporaries are reused."""
    k = h.shape[1]
    u = h @ p["U"]
    gates = u[:, : 2 * k] + x[:, : 2 * k]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    m = gates[:, k:] * u[:, 2 * k :]
    m += x[:, 2 * k :]
    np.tanh(m, out=m)
    new = h - m
    new *= gates[:, :k]
    new += m
    return new, gates, m, u[:, 2 * k :]


#: exp of no more than this is finite, with room for sums.
_MOST_LOGIT = 80
#: Rows of logits that are worked on at once, few enough to stay near a core.
_ROWS = 8192


def _joined(w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with the bias as their last row, and whether no state (within -1 and 1) can give a logit above _MOST_LOGIT."""
    own = np.concatenate([w, bias[..., None, :]], -2)
    return own, bool(np.abs(own).sum(-2).max() <= _MOST_LOGIT)


def _exp_sums(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows and their sums, in place; rows are shifted only where exp would overflow."""
    if not safe and x.size and x.max() > _MOST_LOGIT:
        x -= x.max(1, keepdims=True) - _MOST_LOGIT
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _softmax_loss(x: np.ndarray, picked: np.ndarray, safe: bool, share: float) -> tuple[np.ndarray, float]:
    """The gradient of share times the summed loss by the logits, in place, and that loss (unshared)."""
    at = np.arange(len(x)) * x.shape[1] + picked
    x, sums = _exp_sums(x, safe)
    flat = x.reshape(-1)
    loss = float((np.log(sums) - np.log(flat[at])).sum())
    x *= (np.float32(share) / sums)[:, None]
    flat[at] -= np.float32(share)
    return x, loss


def _log_chosen(x: np.ndarray, picked: np.ndarray, safe: bool) -> np.ndarray:
    at = np.arange(len(x)) * x.shape[1] + picked
    x, sums = _exp_sums(x, safe)
    return np.log(x.reshape(-1)[at]) - np.log(sums)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """ids in 16 bits where they fit: those are sorted by radix."""
    return ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids


def _by_class(ids: np.ndarray, classes: int, size: int):
    """Class of each id; positions of the words in the order of their classes; (class, from, to) in that order for those that occur."""
    words = classes * size
    of = np.where(ids < words, ids // size, ids - words + classes)
    order = np.argsort(_narrow(of), kind="stable")
    edge = np.searchsorted(of[order], np.arange(classes + 1))
    return of, order[: edge[classes]], [(c, edge[c], edge[c + 1]) for c in range(classes) if edge[c] < edge[c + 1]]


def _word_logits(own: np.ndarray, w: np.ndarray, groups: list) -> np.ndarray:
    """Logits of the words of each row's class, of rows in the order of their classes."""
    out = np.empty((len(own), w.shape[2]), np.float32)
    for c, lo, hi in groups:
        np.matmul(own[lo:hi], w[c], out=out[lo:hi])
    return out


def _log_probs(flat: np.ndarray, ids: np.ndarray, to_class: tuple[np.ndarray, bool], to_word: tuple[np.ndarray, bool]) -> np.ndarray:
    """Natural logs of P(class) and, for words, P(word | class), of states that end in a one."""
    (C, safe), (W, safe_words) = to_class, to_word
    classes, _, size = W.shape
    out = np.empty(len(ids), np.float32)
    for lo in range(0, len(ids), _ROWS):
        h, own_ids, got = flat[lo : lo + _ROWS], ids[lo : lo + _ROWS], out[lo : lo + _ROWS]
        of, at, groups = _by_class(own_ids, classes, size)
        got[:] = _log_chosen(h @ C, of, safe)
        got[at] += _log_chosen(_word_logits(h.take(at, 0), W, groups), own_ids[at] % size, safe_words)
    return out


def token_log_probs(p: Params, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logs of P(class) and, for words, P(word | class)."""
    return _log_probs(np.append(h, np.ones((len(h), 1), h.dtype), 1), ids, _joined(p["C"], p["c"]), _joined(p["W"], p["w"]))


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: Params) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            self.p[k] -= (self.rate / a) * m / (np.sqrt(v / b) + 1e-6)


def train(p: Params, ids: np.ndarray, end: int, rate: float = LEARNING_RATE, streams: int = STREAMS, window: int = WINDOW) -> float:
    """One pass over the token ids of consecutive texts, in place; the mean loss in nats.

    Every id is a target once: streams are filled up at the end with masked targets (-1).
    """
    streams = max(1, min(streams, len(ids) // (4 * window) or 1))
    if not len(ids):
        return 0.0
    length = -(-len(ids) // streams)
    fill = length * streams - len(ids)
    target = np.append(ids, np.full(fill, -1, np.int32)).reshape(streams, length).T
    given = np.append(np.int32(end), np.append(ids[:-1], np.full(fill, end, np.int32))).reshape(streams, length).T
    k = p["U"].shape[0]
    classes, size = p["w"].shape
    adam, h, total = Adam(p, rate), np.zeros((streams, k), np.float32), 0.0
    for lo in range(0, length, window):
        prev, goal = given[lo : lo + window], target[lo : lo + window].ravel()
        t_max, n = len(prev), prev.size
        fresh = (prev != end).astype(np.float32)[:, :, None]
        x = p["E"].take(prev, 0)
        states = np.ones((t_max, streams, k + 1), np.float32)  # the last one stands for the bias
        was, cand, recur = (np.empty((t_max, streams, k), np.float32) for _ in range(3))
        gates = np.empty((t_max, streams, 2 * k), np.float32)
        for t in range(t_max):
            np.multiply(h, fresh[t], out=was[t])
            h, gates[t], cand[t], recur[t] = _step(p, x[t], was[t])
            states[t, :, :k] = h
        flat = states.reshape(n, k + 1)
        real = None
        if goal.min() < 0:
            real = np.flatnonzero(goal >= 0)
            flat, goal = flat[real], goal[real]

        (C, safe), (W, safe_words) = _joined(p["C"], p["c"]), _joined(p["W"], p["w"])
        of, at, groups = _by_class(goal, classes, size)
        share = 1 / len(goal)
        d, loss = _softmax_loss(flat @ C, of, safe, share)
        total += loss
        both = flat.T @ d
        g = {"C": both[:k], "c": both[k], "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
        dflat = d @ p["C"].T
        own, down = flat.take(at, 0), np.empty((len(at), k), np.float32)
        d, loss = _softmax_loss(_word_logits(own, W, groups), goal[at] % size, safe_words, share)
        total += loss
        for c, begin, stop in groups:
            both = own[begin:stop].T @ d[begin:stop]
            g["W"][c], g["w"][c] = both[:k], both[k]
            np.matmul(d[begin:stop], p["W"][c].T, out=down[begin:stop])
        dflat[at] += down
        if real is not None:
            dreal, dflat = dflat, np.zeros((n, k), np.float32)
            dflat[real] = dreal

        # what the loop multiplies with, for all steps at once
        z, r = gates[:, :, :k], gates[:, :, k:]
        to_cand = (1 - z) * (1 - cand * cand)
        to_z = (was - cand) * z * (1 - z)
        to_r = recur * r * (1 - r)
        dstates, dcand, du = dflat.reshape(t_max, streams, k), np.empty_like(cand), np.empty_like(x)
        back, dh = np.ascontiguousarray(p["U"].T), np.zeros((streams, k), np.float32)
        for t in range(t_max - 1, -1, -1):
            dh += dstates[t]
            np.multiply(dh, to_cand[t], out=dcand[t])
            np.multiply(dh, to_z[t], out=du[t, :, :k])
            np.multiply(dcand[t], to_r[t], out=du[t, :, k : 2 * k])
            np.multiply(dcand[t], r[t], out=du[t, :, 2 * k :])
            dh *= z[t]
            dh += du[t] @ back
            dh *= fresh[t]
        g["U"] = was.reshape(n, k).T @ du.reshape(n, 3 * k)
        dx = du
        dx[:, :, 2 * k :] = dcand
        flat_prev = _narrow(prev.ravel())
        order = np.argsort(flat_prev, kind="stable")
        rows, first = np.unique(flat_prev[order], return_index=True)
        g["E"] = np.zeros_like(p["E"])
        g["E"][rows] = np.add.reduceat(dx.reshape(n, -1)[order], first)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        if norm > 1:
            g = {key: v / norm for key, v in g.items()}
        adam.step(g)
    return total / len(ids)


def score(p: Params, texts: list[np.ndarray], end: int, group: int = 16384, window: int = SCORE_WINDOW) -> np.ndarray:
    """The natural log-likelihood of each whole text (ids, the end token last); state is carried throughout.

    Of each group of texts, the longest first, those that have a token at a step are the first so many; steps are
    worked on until window of them, or about _ROWS tokens, are there.
    """
    out = np.zeros(len(texts))
    k = p["U"].shape[0]
    to_class, to_word = _joined(p["C"], p["c"]), _joined(p["W"], p["w"])
    order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
    for lo in range(0, len(order), group):
        own = order[lo : lo + group]
        sizes = np.array([len(texts[i]) for i in own])
        ids = np.concatenate([texts[i] for i in own])
        first = np.cumsum(sizes) - sizes
        given = np.append(np.int32(end), ids[:-1])
        given[first[sizes > 0]] = end
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        total, h, at = np.zeros(len(own)), np.zeros((len(own), k), np.float32), 0
        while at < len(active):
            until = at + max(1, min(window, int(np.searchsorted(np.cumsum(active[at : at + window]), _ROWS))))
            counts = active[at:until]
            begin = np.append(0, np.cumsum(counts))
            rows = np.arange(begin[-1]) - np.repeat(begin[:-1], counts)
            place = first[rows] + np.repeat(np.arange(at, at + len(counts)), counts)
            x = p["E"].take(given[place], 0)
            flat = np.ones((begin[-1], k + 1), np.float32)
            for t, a in enumerate(counts.tolist()):
                h = _step(p, x[begin[t] : begin[t + 1]], h[:a])[0]
                flat[begin[t] : begin[t + 1], :k] = h
            got = np.bincount(rows, _log_probs(flat, ids[place], to_class, to_word))
            total[: len(got)] += got
            at += len(counts)
        out[own] = total
    return out
