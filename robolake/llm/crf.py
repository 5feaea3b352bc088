"""A linear-chain conditional random field with two labels, 0 and 1.

The score of a sequence of labels is the sum of w[f] over the features f of the blocks labelled 1 and of t[e][a][b] over neighbours labelled a and b
that are joined by an edge of kind e. Training climbs the log-likelihood of the labels less a Gaussian penalty, with expectations from forward and
backward sums over all training sequences at once; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = 2


@dataclass
class Crf:
    weights: dict[str, float]
    steps: list  # steps[kind][a][b]

    def decode(self, features: list[list[str]], kinds: list[int]) -> list[int]:
        """The likeliest labels; of equally likely ones a block, seen from the end, takes 0."""
        if not features:
            return []
        w = self.weights
        own = [sum(w[f] for f in fs if f in w) for fs in features]
        zero, one, back = 0.0, own[0], []
        for x, kind in zip(own[1:], kinds, strict=True):
            (t00, t01), (t10, t11) = self.steps[kind]
            a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + x
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


class _Chains:
    """Training sequences, padded to the longest, and the places of their features."""

    def __init__(self, rows: list[tuple[list[list[str]], list[int], list[int]]]):
        self.index: dict[str, int] = {}
        self.n, self.length = len(rows), max(len(y) for _, _, y in rows)
        shape = (self.n, self.length)
        self.mask, self.y, self.kind = np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        flat, owner = [], []
        for r, (features, kinds, y) in enumerate(rows):
            self.mask[r, : len(y)] = True
            self.y[r, : len(y)] = y
            self.kind[r, 1 : len(y)] = kinds
            for k, fs in enumerate(features):
                flat += [self.index.setdefault(f, len(self.index)) for f in fs]
                owner += [r * self.length + k] * len(fs)
        self.flat, self.owner = np.array(flat), np.array(owner)
        self.seen = np.bincount(self.flat, minlength=len(self.index))
        at = np.flatnonzero(self.mask[:, 1:])
        self.pair = (at // (self.length - 1), at % (self.length - 1) + 1) if self.length > 1 else (at, at)

    def objective(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradients."""
        n, length, mask = self.n, self.length, self.mask
        u = np.zeros((n, length, 2))
        u[:, :, 1] = np.bincount(self.owner, w[self.flat], minlength=n * length).reshape(n, length)
        step = t[self.kind]
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = u[:, 0]
        for k in range(1, length):
            new = u[:, k] + np.logaddexp(fwd[:, k - 1, :1] + step[:, k, 0], fwd[:, k - 1, 1:] + step[:, k, 1])
            fwd[:, k] = np.where(mask[:, k, None], new, fwd[:, k - 1])
        for k in range(length - 2, -1, -1):
            ahead = (u[:, k + 1] + bwd[:, k + 1])[:, None, :] + step[:, k + 1]
            bwd[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(ahead[:, :, 0], ahead[:, :, 1]), 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * mask
        gold = (self.y * u[:, :, 1]).sum()
        off = ((self.y - p) * mask).ravel()
        gw = np.bincount(self.flat, off[self.owner], minlength=len(w))
        gt = np.zeros_like(t)
        r, k = self.pair
        if len(r):
            joint = fwd[r, k - 1][:, :, None] + step[r, k] + (u[r, k] + bwd[r, k])[:, None, :] - z[r, None, None]
            a, b, kind = self.y[r, k - 1], self.y[r, k], self.kind[r, k]
            gold += t[kind, a, b].sum()
            np.add.at(gt, (kind, a, b), 1.0)
            np.subtract.at(gt, kind, np.exp(joint))
        return float(gold - z.sum()), gw, gt


def train(rows: list[tuple[list[list[str]], list[int], list[int]]], rounds: int = 100, penalty: float = 0.05, least: int = 3, rate: float = 0.15) -> Crf:
    """Fit sequences (features of each block, kinds of the edges, labels) by full gradient steps of adaptive size (Adam); features seen less than ``least`` times
    get no weight. The same rows give the same model. Sequences without blocks are left out; without any, all weights are 0."""
    rows = [r for r in rows if r[2]]
    if not rows:
        return Crf({}, np.zeros((KINDS, 2, 2)).tolist())
    chains = _Chains(rows)
    x = np.zeros(len(chains.index) + KINDS * 4)
    on = np.append(chains.seen >= least, np.ones(KINDS * 4, bool))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        _, gw, gt = chains.objective(x[: -KINDS * 4], x[-KINDS * 4 :].reshape(KINDS, 2, 2))
        g = (np.append(gw, gt.ravel()) - penalty * x) * on
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights = {f: float(x[i]) for f, i in chains.index.items() if on[i]}
    return Crf(weights, x[-KINDS * 4 :].reshape(KINDS, 2, 2).tolist())
