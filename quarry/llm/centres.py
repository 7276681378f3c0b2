"""k-means on a bounded sample, in numpy on the driver."""

from __future__ import annotations

import numpy as np

#: Rows whose distances to all centres are held at once, as numbers.
NUMBERS = 1 << 22


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equal ones."""
    square, step = (centres**2).sum(axis=1), max(1, NUMBERS // max(1, len(centres)))
    return np.concatenate([(square - 2 * x[i : i + step] @ centres.T).argmin(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int) -> np.ndarray:
    """At most ``k`` centres, begun at rows drawn by ``seed``; one that loses all its rows stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres
