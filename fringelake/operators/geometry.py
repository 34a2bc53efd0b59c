"""Sidereal time, station angles, and (u, v) coordinates of an array on the rotating Earth."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .visibility import DEGREE

HOUR = 15.0 * DEGREE
LIGHT = 299792458.0
ELEVATIONS = (10.0, 85.0)
SIDEREAL = 0.9972695601848
#: Stations of an array; a longer list is refused.
MOST_STATIONS = 2000


@dataclass(frozen=True)
class Source:
    """Right ascension (hours), declination (degrees), frequency (Hz) and day."""

    ra: float
    dec: float
    frequency: float
    mjd: int


def gmst(utc: Column, mjd: int) -> Column:
    """Mean sidereal time at Greenwich in hours (IAU 2006, UT1 taken as UTC)."""
    days = F.lit(mjd - 51544.5) + utc / 24.0
    t = days / 36525.0
    hours = 24.0 * (0.7790572732640 + 1.00273781191135448 * days) + (0.014506 + 4612.156534 * t + 1.3915817 * t * t) / 54000.0
    return hours - 24.0 * F.floor(hours / 24.0)


def utc(sidereal: Column, mjd: int) -> Column:
    """UTC hours of sidereal hours after the day's first."""
    return (sidereal - gmst(F.lit(0.0), mjd)) * SIDEREAL


def _wrapped(angle: Column) -> Column:
    turn = 2 * math.pi
    return angle - turn * F.floor(angle / turn)


def _rotated(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    return x * F.cos(theta) - y * F.sin(theta), x * F.sin(theta) + y * F.cos(theta)


def theta(sidereal: Column, source: Source) -> Column:
    return _wrapped((sidereal - source.ra) * HOUR)


def elevation(x: Column, y: Column, z: Column, angle: Column, source: Source) -> Column:
    """Radians."""
    c, s = math.cos(source.dec * DEGREE), math.sin(source.dec * DEGREE)
    return 0.5 * math.pi - F.acos((_rotated(x, y, angle)[0] * c + z * s) / F.sqrt(x * x + y * y + z * z))


def hour_angle(x: Column, y: Column, sidereal: Column, source: Source) -> Column:
    return _wrapped(sidereal * HOUR + F.atan2(y, x) - source.ra * HOUR)


def parallactic(hour: Column, x: Column, y: Column, z: Column, source: Source) -> Column:
    lat, dec = F.atan2(z, F.sqrt(x * x + y * y)), source.dec * DEGREE
    return F.atan2(F.sin(hour) * F.cos(lat), F.sin(lat) * math.cos(dec) - F.cos(lat) * math.sin(dec) * F.cos(hour))


def with_stations(vis: DataFrame, stations: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the coordinates of its stations: x1, y1, z1, x2, y2, z2 (and ``extra`` columns alike)."""
    out = vis
    for k in ("1", "2"):
        out = out.join(stations.select(F.col("site").alias(f"t{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "z", *extra)]), f"t{k}")
    return out


def station_angles(vis: DataFrame, stations: DataFrame, source: Source, unit: float = DEGREE) -> DataFrame:
    """el, hr_ang and par_ang of both stations, beside the keys."""
    out = with_stations(vis, stations).withColumn("_gmst", gmst(F.col("time"), source.mjd))
    columns = []
    for k in ("1", "2"):
        x, y, z = (F.col(f"{c}{k}") for c in "xyz")
        hour = hour_angle(x, y, F.col("_gmst"), source)
        columns += [(elevation(x, y, z, theta(F.col("_gmst"), source), source) / unit).alias(f"el{k}"), (hour / unit).alias(f"hr_ang{k}"), (parallactic(hour, x, y, z, source) / unit).alias(f"par_ang{k}")]
    return out.select("time", "t1", "t2", *columns)


def uv(source: Source, sidereal: Column) -> tuple[Column, Column]:
    """(u, v) in wavelengths of a row with x1 ... z2."""
    angle, wave = theta(sidereal, source), LIGHT / source.frequency
    dx, dy = _rotated(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), angle)
    c, s = math.cos(source.dec * DEGREE), math.sin(source.dec * DEGREE)
    return dy / wave, (c * (F.col("z1") - F.col("z2")) - s * dx) / wave


def recompute_uv(vis: DataFrame, stations: DataFrame, source: Source) -> DataFrame:
    out = with_stations(vis.withColumn("_gmst", gmst(F.col("time"), source.mjd)), stations)
    u, v = uv(source, F.col("_gmst"))
    return out.withColumns({"u": u, "v": v}).drop("_gmst", *[f"{c}{k}" for c in "xyz" for k in "12"])


def _seen(source: Source, low: float, high: float) -> Column:
    both = None
    for k in ("1", "2"):
        e = elevation(*(F.col(f"{c}{k}") for c in "xyz"), theta(F.col("_gmst"), source), source) / DEGREE
        one = (e > low) & (e < high)
        both = one if both is None else both & one
    return both


def flag_elevation(vis: DataFrame, stations: DataFrame, source: Source, low: float = ELEVATIONS[0], high: float = ELEVATIONS[1], output: str = "kept") -> DataFrame:
    """Rows whose stations both see the source between the elevations (degrees), the others, or all with ``kept``."""
    out = with_stations(vis.withColumn("_gmst", gmst(F.col("time"), source.mjd)), stations)
    out = out.withColumn("kept", F.coalesce(_seen(source, low, high), F.lit(False))).drop("_gmst", *[f"{c}{k}" for c in "xyz" for k in "12"])
    return out if output == "both" else out.filter("kept" if output == "kept" else "not kept").drop("kept")


def thermal_noise(sefd1: Column, sefd2: Column, seconds: float, bandwidth: float) -> Column:
    """Of a hand's product on a baseline; 0.88 stands for two-bit sampling."""
    return F.sqrt(sefd1 * sefd2 / (2 * bandwidth * seconds)) / 0.88


def baselines(stations: DataFrame) -> DataFrame:
    """All pairs of stations in order, with x1 ... z2 and their sensitivities; an array has ``MOST_STATIONS`` at most."""
    rows = sorted(tuple(r) for r in stations.select("site", "x", "y", "z", "sefd").limit(MOST_STATIONS + 1).collect())
    if len(rows) > MOST_STATIONS:
        raise ValueError(f"more than {MOST_STATIONS} stations")
    pairs = [(*a, *b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    return stations.sparkSession.createDataFrame(pairs, "t1 string, x1 double, y1 double, z1 double, sefd1 double, t2 string, x2 double, y2 double, z2 double, sefd2 double")


def make_uvpoints(times: DataFrame, stations: DataFrame, source: Source, seconds: float, bandwidth: float, low: float = ELEVATIONS[0], high: float = ELEVATIONS[1]) -> DataFrame:
    """(time, t1, t2, u, v, tint, sigma): every baseline at every time at which both stations see the source."""
    rows = times.select("time", gmst(F.col("time"), source.mjd).alias("_gmst")).crossJoin(F.broadcast(baselines(stations))).filter(_seen(source, low, high))
    u, v = uv(source, F.col("_gmst"))
    return rows.select("time", "t1", "t2", u.alias("u"), v.alias("v"), F.lit(float(seconds)).alias("tint"), thermal_noise(F.col("sefd1"), F.col("sefd2"), seconds, bandwidth).alias("sigma"))


def site_names(hours: Column) -> Column:
    """Hours as ``hh:mm:ss.ssss`` text."""
    h = F.floor(hours)
    m = F.floor((hours - h) * 60)
    return F.format_string("%02d:%02d:%07.4f", h, m, ((hours - h) * 60 - m) * 60)
