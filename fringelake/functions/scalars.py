"""Scalar functions in column expressions: errors, debiasing, formats, dates, pulses, numbers drawn by hash."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fractional_error(i: Column, m: Column, sigma: Column, *cross: Column) -> Column:
    """Error of each part of a fractional polarisation m of amplitude i: the cross errors in quadrature with m sigma."""
    total = sigma * sigma * m * m
    for s in cross:
        total = total + s * s
    return F.sqrt(total) / F.abs(i)


def debiased_closure_amplitude(camp: Column, snr3: Column, snr4: Column) -> Column:
    return camp / (1 + 1 / (snr3 * snr3) + 1 / (snr4 * snr4))


def debiased_log_closure_amplitude(camp: Column, *snr: Column) -> Column:
    one, two, three, four = (1 / (s * s) for s in snr)
    return camp + (one + two - three - four) / 2


def parity(first: list[Column], second: list[Column]) -> Column:
    """1 or -1: whether an even or odd number of exchanges turns one order of distinct names into the other (NULL if none does)."""
    n = len(first)
    # Inversions of the places that the first order's names have in the second.
    places = [F.array_position(F.array(*second), a) for a in first]
    odd = sum((F.when(places[i] > places[j], 1).otherwise(0) for i in range(n) for j in range(i + 1, n)), F.lit(0))
    known = F.lit(True)
    for p in places:
        known = known & (p > 0)
    return F.when(known & (F.size(F.array_distinct(F.array(*first))) == n), 1 - 2 * F.pmod(odd, F.lit(2)))


def _sexagesimal(x: Column) -> tuple[Column, Column, Column]:
    """Whole part, minutes and seconds of a number not below 0."""
    h = F.floor(x)
    m = F.floor((x - h) * 60)
    return h, m, (x - h - m / 60) * 3600


def ra_text(hours: Column) -> Column:
    h, m, s = _sexagesimal(hours)
    return F.format_string("%2d h %2d m %2.4f s", h, m, s)


def dec_text(degrees: Column) -> Column:
    d, m, s = _sexagesimal(F.abs(degrees))
    return F.format_string("%2d deg %2d m %2.4f s", F.when(degrees < 0, -d).otherwise(d), m, s)


def gmt_text(hours: Column) -> Column:
    h, m, s = _sexagesimal(F.when(hours > 24, hours - 24).otherwise(hours))
    return F.format_string("%02d:%02d:%2.4f", h, m, s)


def round_time(time: Column, seconds: float = 0.1) -> Column:
    """A timestamp to the nearest multiple of ``seconds`` since its year began, halves to even, whole microseconds."""
    year = F.date_trunc("year", time)
    since = (F.unix_micros(time) - F.unix_micros(year)) / 1e6
    return F.timestamp_micros(F.unix_micros(year) + F.floor(F.rint(since / seconds) * seconds * 1e6 + 1e-3).cast("long"))


def schedule_date(text: Column) -> tuple[Column, Column]:
    """(mjd, hour) of a text such as 2017y095d04h30m00s."""
    part = lambda k: F.get(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d*)?)"), 1), F.lit(k))
    first = F.make_date(part(0).cast("int"), F.lit(1), F.lit(1))
    mjd = F.datediff(first, F.lit("1858-11-17").cast("date")) + part(1).cast("int") - 1
    return mjd, part(2).cast("double") + part(3).cast("double") / 60 + part(4).cast("double") / 3600


def q_value(i: Column, m: Column, chi: Column) -> Column:
    return i * m * F.cos(2 * chi)


def u_value(i: Column, m: Column, chi: Column) -> Column:
    return i * m * F.sin(2 * chi)


PULSES = ("delta", "rect", "triangle", "gauss", "cubic", "sinc")


def pulse(kind: str, x: Column, width: float) -> Column:
    """One-dimensional pixel shape at ``x``, of unit integral (delta: 1 at 0); gauss has a deviation of a third of the width."""
    t = F.abs(x) / width
    if kind == "delta":
        return F.when(x == 0, 1.0).otherwise(0.0)
    if kind == "rect":
        return F.when(t >= 0.5, 0.0).otherwise(1 / width)
    if kind == "triangle":
        return F.when(t > 1, 0.0).otherwise((1 - t) / width)
    if kind == "gauss":
        return F.exp(-4.5 * t * t) * (3 / (width * math.sqrt(2 * math.pi)))
    if kind == "cubic":
        return F.when(t < 1, (1.5 * t - 2.5) * t * t + 1).when(t <= 2, ((-0.5 * t + 2.5) * t - 4) * t + 2).otherwise(0.0) / width
    if kind == "sinc":
        return F.when(t == 0, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * t)) / width
    raise ValueError(kind)


def pulse_transform(kind: str, omega: Column, width: float) -> Column:
    """The pulse's transform at the angular frequency ``omega``."""
    h = omega * width / 2
    s = F.when(h == 0, 1.0).otherwise(F.sin(h) / h)
    if kind == "delta":
        return F.lit(1.0)
    if kind == "rect":
        return s
    if kind == "triangle":
        return s * s
    if kind == "gauss":
        return F.exp(-omega * omega * (width * width / 18))
    if kind == "cubic":
        return F.when(h == 0, 1.0).otherwise((3 * s - 2 * F.cos(h)) * s * s * s)
    if kind == "sinc":
        return F.when(F.abs(omega) <= math.pi / width, 1.0).otherwise(0.0)
    raise ValueError(kind)


def hash_uniform(*keys: Column) -> Column:
    """In (0, 1), fixed by the keys on every run and partitioning."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def hash_normal(*keys: Column) -> Column:
    """Of the standard normal distribution, fixed by the keys (Box and Muller)."""
    return F.sqrt(-2 * F.log(hash_uniform(*keys, F.lit("radius")))) * F.cos(2 * math.pi * hash_uniform(*keys, F.lit("angle")))


def hash_choice(values: list, *keys: Column) -> Column:
    """One of ``values``, fixed by the keys."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(hash_uniform(*keys) * len(values)).cast("int"))


def kernel_covariance(times: np.ndarray, scale: float) -> np.ndarray:
    """Squared-exponential covariance of times, of unit variance."""
    d = np.subtract.outer(times, times)
    return np.exp(-(d**2) / (2 * scale**2))


def power_of_two(target: float) -> int:
    """The least power of two that is not below ``target``, 1 at least."""
    return 1 if target <= 1 else 1 << math.ceil(math.log2(target))
