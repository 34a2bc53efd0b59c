"""Minimisation of smooth functions of moderately many numbers, with numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 200, memory: int = 12, tolerance: float = 1e-10) -> np.ndarray:
    """The lowest point that limited-memory BFGS finds from ``x``; ``f`` gives value and gradient.

    A step is halved until it meets the Armijo condition; pairs without positive curvature are left out.
    """
    x = np.array(x, float)
    value, slope = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, sizes = slope.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ way)
            way -= a * y
            sizes.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.abs(slope).max())
        for (s, y, r), a in zip(pairs, reversed(sizes), strict=True):
            way += (a - r * (y @ way)) * s
        way = -way
        down = slope @ way
        if not down < 0:
            if not pairs:
                break
            pairs = []
            continue
        length = 1.0
        while True:
            there = x + length * way
            new_value, new_slope = f(there)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * down:
                break
            length /= 2
            if length < 1e-14:
                break
        if length < 1e-14:
            if not pairs:
                break
            pairs = []
            continue
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value <= tolerance * max(abs(value), abs(new_value), 1e-30)
        x, value, slope = there, new_value, new_slope
        if done:
            break
    return x
