"""Bessel functions of the first kind and integer order, with numpy only."""

from __future__ import annotations

import numpy as np

#: Arguments up to this are integrated, by so many points; beyond, the asymptotic series serves.
FAR, POINTS = 200.0, 320


def jn(n: int, z: np.ndarray) -> np.ndarray:
    """J_n(z) for |n| up to 30: the mean of cos(n t - z sin t) over [0, pi], exact to rounding by the trapezoid rule."""
    z = np.asarray(z, float)
    out = np.empty(z.shape)
    near = np.abs(z) <= FAR
    t = (np.arange(POINTS) + 0.5) * np.pi / POINTS
    flat = z[near]
    parts = [np.cos(n * t - np.outer(flat[a : a + 4096], np.sin(t))).mean(1) for a in range(0, len(flat), 4096)]
    out[near] = np.concatenate(parts) if parts else 0.0
    far = np.abs(z[~near])
    if len(far):
        mu, term, p, q = 4.0 * n * n, np.ones(len(far)), np.zeros(len(far)), np.zeros(len(far))
        for k in range(8):
            p, q = (p + (-1) ** (k // 2) * term, q) if k % 2 == 0 else (p, q + (-1) ** (k // 2) * term)
            term = term * (mu - (2 * k + 1) ** 2) / ((k + 1) * 8 * far)
        turn = far - (n / 2 + 0.25) * np.pi
        sign = np.where((z[~near] < 0) & (n % 2 == 1), -1.0, 1.0)
        out[~near] = sign * np.sqrt(2 / (np.pi * far)) * (p * np.cos(turn) - q * np.sin(turn))
    return out
