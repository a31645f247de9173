"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


class Curve:
    """A monotone step function through points, linear between them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def __call__(self, at):
        return np.interp(at, self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Curve:
    """The monotone fit of ``y`` to ``x``; equal ``x`` are one point."""
    weight = np.ones(len(x)) if weight is None else weight
    at, place = np.unique(x, return_inverse=True)
    w = np.bincount(place, weight)
    mean = np.bincount(place, weight * y) / np.maximum(w, 1e-12)
    pools: list[list[float]] = []  # mean, weight, first, last
    for i, (m, n) in enumerate(zip(mean, w, strict=True)):
        pools.append([m, n, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, n2, _, last = pools.pop()
            m1, n1, first, _ = pools.pop()
            pools.append([(m1 * n1 + m2 * n2) / max(n1 + n2, 1e-12), n1 + n2, first, last])
    xs = np.array([at[i] for p in pools for i in (int(p[2]), int(p[3]))])
    ys = np.array([p[0] for p in pools for _ in range(2)])
    return Curve(xs, np.clip(ys, 0, 1))
