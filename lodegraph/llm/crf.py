"""A linear-chain conditional random field of two labels: training, marginals and Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _chains(sizes: np.ndarray) -> list[np.ndarray]:
    """For each step t, the rows (over all chains laid end to end, longest chain first) that are t-th in their chain."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    alive = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")
    return [first[: alive[t]] + t for t in range(len(alive))]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of rows, expected transition counts and the log partition summed over chains. emit: scores by row and label."""
    steps = _chains(sizes)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t, rows in enumerate(steps):
        alpha[rows] = emit[rows] + (start if not t else _logsum(alpha[rows - 1][:, :, None] + trans, 1))
    for t in range(len(steps) - 2, -1, -1):
        rows = steps[t + 1]
        beta[rows - 1] = _logsum(trans + (emit[rows] + beta[rows])[:, None, :], 2)
    ends = np.cumsum(sizes) - 1
    z = _logsum(alpha[ends], 1)
    per_row = np.repeat(z, sizes)
    marginal = np.exp(alpha + beta - per_row[:, None])
    moves = np.zeros((2, 2))
    for rows in steps[1:]:
        moves += np.exp(alpha[rows - 1][:, :, None] + trans + (emit[rows] + beta[rows])[:, None, :] - per_row[rows][:, None, None]).sum(axis=0)
    return marginal, moves, float(z.sum())


@dataclass
class CRF:
    """weights: a score for label 1 by feature (label 0 scores nothing); trans: by label and next label; start: by label."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emit(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weights], axis=1)

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of chains laid end to end; no chain is empty."""
        return forward_backward(self.emit(x), self.trans, self.start, sizes)[0][:, 1] if len(x) else np.zeros(0)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of one chain; ties go to label 0."""
        emit = self.emit(x)
        best, back = self.start + emit[0], []
        for row in emit[1:]:
            via = best[:, None] + self.trans
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def train_crf(xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> CRF:
    """Maximum likelihood by full-batch Adam; xs and ys by chain, none empty."""
    x, y = np.concatenate(xs), np.concatenate(ys).astype(int)
    sizes = np.array([len(a) for a in ys])
    starts = np.cumsum(sizes) - sizes
    d = x.shape[1]
    target = np.zeros(d + 6)
    target[:d] = x[y == 1].sum(axis=0)
    follows = np.ones(len(y), dtype=bool)
    follows[starts] = False
    at = np.flatnonzero(follows)
    np.add.at(target, d + 2 * y[at - 1] + y[at], 1)
    np.add.at(target, d + 4 + y[starts], 1)
    theta, m, v = np.zeros(d + 6), np.zeros(d + 6), np.zeros(d + 6)
    for k in range(1, rounds + 1):
        field = CRF(theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :])
        marginal, moves, _ = forward_backward(field.emit(x), field.trans, field.start, sizes)
        expected = np.concatenate([x.T @ marginal[:, 1], moves.ravel(), marginal[starts].sum(axis=0)])
        g = (expected - target) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return CRF(theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :])
