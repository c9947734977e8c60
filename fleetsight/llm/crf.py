"""A linear-chain conditional random field over a few categorical features per token, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Chain:
    labels: list[str]
    values: list[dict[str, int]]  # per feature: value -> row of its table; row 0 for values not seen in training
    tables: list[np.ndarray]  # per feature: (values, labels)
    moves: np.ndarray  # (labels, labels)
    first: np.ndarray
    last: np.ndarray

    def rows(self, tokens: list[tuple[str, ...]]) -> np.ndarray:
        return np.array([[v.get(x, 0) for v, x in zip(self.values, t)] for t in tokens], np.int32).reshape(len(tokens), len(self.values))

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((*rows.shape[:-1], len(self.labels)))
        for f, table in enumerate(self.tables):
            out += table[rows[..., f]]
        return out

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each sequence of feature rows; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        order = [k for k in order if len(sequences[k])]
        at = 0
        while at < len(order):
            most = max(2 * len(sequences[order[at]]), 16)
            batch = [k for k in order[at : at + max(1, 1_000_000 // most)] if len(sequences[k]) <= most]
            at += len(batch)
            for k, path in zip(batch, self._decode([sequences[k] for k in batch])):
                out[k] = path
        return out

    def _decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        n, sizes = len(sequences), np.array([len(s) for s in sequences])
        longest = sizes.max()
        rows = np.zeros((n, longest, len(self.tables)), sequences[0].dtype)
        for k, s in enumerate(sequences):
            rows[k, : len(s)] = s
        scores = self.emissions(rows)
        best = self.first + scores[:, 0]
        back = np.zeros((longest, n, len(self.labels)), np.int8)
        final = np.where((sizes == 1)[:, None], best + self.last, -np.inf)
        for t in range(1, longest):
            step = best[:, :, None] + self.moves
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
            final = np.where((sizes == t + 1)[:, None], best + self.last, final)
        paths = np.zeros((n, longest), np.int64)
        now = final.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            inside = t < sizes
            paths[inside, t] = now[inside]
            now = np.where(inside, back[t][np.arange(n), now], now)
        return [p[:size] for p, size in zip(paths, sizes)]


def trained(sentences: list[tuple[list[tuple[str, ...]], list[str]]], passes: int = 150, rate: float = 0.3, decay: float = 0.01, allowed=None) -> Chain:
    """Maximum penalised likelihood by gradient ascent with adaptive steps; forward and backward sums per sentence.

    ``allowed(a, b)`` forbids label moves for good.
    """
    labels = sorted({y for _, ys in sentences for y in ys})
    number = {y: k for k, y in enumerate(labels)}
    values: list[dict[str, int]] = [{} for _ in sentences[0][0][0]]
    for xs, _ in sentences:
        for x in xs:
            for v, value in zip(values, x):
                v.setdefault(value, len(v) + 1)
    size = len(labels)
    chain = Chain(labels, values, [np.zeros((len(v) + 1, size)) for v in values], np.zeros((size, size)), np.zeros(size), np.zeros(size))
    barred = np.array([[not (allowed is None or allowed(a, b)) for b in labels] for a in labels])
    bar_first = np.array([not (allowed is None or allowed("", b)) for b in labels])
    data = [(chain.rows(xs), np.array([number[y] for y in ys])) for xs, ys in sentences]
    params = [*chain.tables, chain.moves, chain.first, chain.last]
    squares = [np.full_like(p, 1e-6) for p in params]
    for _ in range(passes):
        grads = [-decay * p for p in params]
        moves, first = np.where(barred, -1e4, chain.moves), np.where(bar_first, -1e4, chain.first)
        for rows, ys in data:
            e = chain.emissions(rows)
            n = len(ys)
            fore, aft = np.zeros((n, size)), np.zeros((n, size))
            fore[0] = first + e[0]
            for t in range(1, n):
                fore[t] = _lse(fore[t - 1][:, None] + moves, 0) + e[t]
            aft[-1] = chain.last
            for t in range(n - 2, -1, -1):
                aft[t] = _lse(moves + (e[t + 1] + aft[t + 1])[None], 1)
            total = _lse(fore[-1] + chain.last, 0)
            miss = -np.exp(fore + aft - total)
            miss[np.arange(n), ys] += 1
            for f in range(len(chain.tables)):
                np.add.at(grads[f], rows[:, f], miss)
            if n > 1:
                pair = np.exp(fore[:-1, :, None] + moves + (e[1:] + aft[1:])[:, None, :] - total)
                grads[-3] -= pair.sum(axis=0)
                np.add.at(grads[-3], (ys[:-1], ys[1:]), 1)
            grads[-2] += miss[0]
            grads[-1] += miss[-1]
        for p, g, s in zip(params, grads, squares):
            s += g * g
            p += rate * g / np.sqrt(s)
    chain.moves[barred] = -1e4
    chain.first[bar_first] = -1e4
    return chain
