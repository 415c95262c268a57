"""A linear-chain conditional random field in numpy: many chains in lockstep."""

from __future__ import annotations

import numpy as np


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of chains by falling length, how many are still running at each step)."""
    order = np.argsort(-lengths, kind="stable")
    sorted_len = lengths[order]
    steps = int(sorted_len[0]) if len(lengths) else 0
    running = np.searchsorted(-sorted_len, -np.arange(1, steps + 1), "right")
    return order, running


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Marginals (n, L) of chains emit[starts:starts+lengths]; with pairs also the summed pair marginals and the log partition sum.

    Every step handles one position of all chains that are that long, with
    scaled probabilities, so cost is the positions plus the longest chain.
    """
    n, L = emit.shape
    out = np.zeros((n, L))
    if not n:
        return (out, np.zeros((L, L)), 0.0, np.zeros(L)) if pairs else out
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    order, running = lanes(lengths)
    at = starts[order]
    peak = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - peak)
    A = np.exp(trans)
    alpha = np.zeros((n, L))
    scale = np.ones(n)
    a = e[at] * np.exp(first)
    c = a.sum(axis=1)
    a /= c[:, None]
    alpha[at], scale[at] = a, c
    for t in range(1, len(running)):
        k = running[t]
        p = at[:k] + t
        a = (a[:k] @ A) * e[p]
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[p], scale[p] = a, c
    last = starts + lengths - 1
    beta = np.ones((n, L))
    for t in range(len(running) - 1, 0, -1):
        k = running[t]
        p = at[:k] + t
        beta[p - 1] = ((e[p] * beta[p]) @ A.T) / scale[p][:, None]
    out = alpha * beta
    total = out.sum(axis=1, keepdims=True)
    np.divide(out, total, out=out, where=total > 0)
    if not pairs:
        return out
    inner = np.ones(n, bool)
    inner[last] = False
    covered = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    covered = np.cumsum(edge[:-1]) > 0
    i = np.flatnonzero(inner & covered)
    right = e[i + 1] * beta[i + 1] / scale[i + 1][:, None]
    xi = (alpha[i].T @ right) * A
    logz = float(np.log(scale[covered]).sum() + peak[covered].sum())
    return out, xi, logz, out[starts].sum(axis=0)


class Adam:
    def __init__(self, shapes, lr: float):
        self.m = [np.zeros(s) for s in shapes]
        self.v = [np.zeros(s) for s in shapes]
        self.t, self.lr = 0, lr

    def step(self, params, grads):
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.lr * fix * m / (np.sqrt(v) + 1e-8)


def fit_dense(x: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, L: int, rounds: int = 150, lr: float = 0.05, l2: float = 1e-3):
    """Emission weights (d, L), transitions and first-label scores by the conditional likelihood of given labels."""
    w, trans, first = np.zeros((x.shape[1], L)), np.zeros((L, L)), np.zeros(L)
    gold = np.zeros((len(x), L))
    gold[np.arange(len(x)), labels] = 1
    inner = np.ones(len(x), bool)
    inner[starts + lengths - 1] = False
    i = np.flatnonzero(inner)
    gold_pairs = gold[i].T @ gold[i + 1]
    gold_first = gold[starts].sum(axis=0)
    n = max(1, len(x))
    opt = Adam([w.shape, trans.shape, first.shape], lr)
    for _ in range(rounds):
        p, xi, _, pf = forward_backward(x @ w.astype(x.dtype), starts, lengths, trans, first, pairs=True)
        opt.step([w, trans, first], [x.T @ (p - gold).astype(x.dtype) / n + l2 * w, (xi - gold_pairs) / n + l2 * trans, (pf - gold_first) / n + l2 * first])
    return w, trans, first
