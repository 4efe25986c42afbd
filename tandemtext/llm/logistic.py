"""Logistic regression on hashed features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 18


def hashed(features: list[str]) -> list[int]:
    """Places of the features in the weight vector; place 0 is the bias."""
    return [0, *{1 + xxhash.xxh32_intdigest(f) % ((1 << BITS) - 1) for f in features}]


def fit(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, rate: float = 0.2, decay: float = 1e-4, least: int = 3, seed: int = 7) -> np.ndarray:
    """Weights by AdaGrad over shuffled mini-batches of weighted rows; features in fewer than `least` rows keep weight 0. The same rows give the same weights."""
    weights = weights / max(float(weights.mean()), 1e-9) if len(weights) else weights
    width = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(width.sum()))
    known = np.nonzero(np.bincount(flat, minlength=1 << BITS) >= least)[0]
    compact = np.full(1 << BITS, len(known))
    compact[known] = np.arange(len(known))
    flat = compact[flat]
    at = np.concatenate([[0], np.cumsum(width)])
    w, g2 = np.zeros(len(known) + 1), np.full(len(known) + 1, 1e-4)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 128):
            pick = order[a : a + 128]
            places = np.concatenate([flat[at[i] : at[i + 1]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), width[pick])
            z = np.bincount(owner, weights=w[places], minlength=len(pick))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weights[pick]
            grad = np.bincount(places, weights=error[owner], minlength=len(w)) / len(pick) + decay * w
            g2 += grad * grad
            w -= rate * grad / np.sqrt(g2)
            w[-1] = 0.0
    out = np.zeros(1 << BITS)
    out[known] = w[:-1]
    return out


def scores(rows: list[list[int]], w: np.ndarray) -> np.ndarray:
    """The probability of each row."""
    if not rows:
        return np.zeros(0)
    width = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(width.sum()))
    z = np.add.reduceat(w[flat], np.cumsum(width) - width)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
