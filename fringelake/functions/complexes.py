"""Complex numbers as pairs of double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(name: str) -> Pair:
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def conj(x: Pair) -> Pair:
    return x[0], -x[1]


def add(x: Pair, y: Pair) -> Pair:
    return x[0] + y[0], x[1] + y[1]


def sub(x: Pair, y: Pair) -> Pair:
    return x[0] - y[0], x[1] - y[1]


def mul(x: Pair, y: Pair) -> Pair:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]


def scale(x: Pair, k) -> Pair:
    return x[0] * k, x[1] * k


def times_i(x: Pair) -> Pair:
    return -x[1], x[0]


def div(x: Pair, y: Pair) -> Pair:
    """NULL where ``y`` is 0."""
    size = F.nullif(y[0] * y[0] + y[1] * y[1], F.lit(0.0))
    top = mul(x, conj(y))
    return top[0] / size, top[1] / size


def amplitude(x: Pair) -> Column:
    return F.sqrt(x[0] * x[0] + x[1] * x[1])


def phase(x: Pair) -> Column:
    """Radians."""
    return F.atan2(x[1], x[0])
