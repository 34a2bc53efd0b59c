"""Circular statistics, bootstrap intervals, variation reports, and diagonalised closures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE = np.pi / 180


def _resultant(angle: Column) -> tuple[Column, Column]:
    return F.avg(F.cos(angle)), F.avg(F.sin(angle))


def circular_mean(degrees: Column) -> Column:
    """Of angles in degrees, within [-180, 180); NULL of none. Nulls and NaN take no part."""
    c, s = _resultant(F.when(~F.isnan(degrees), F.radians(degrees)))
    return F.pmod(F.degrees(F.atan2(s, c)) + 180.0, F.lit(360.0)) - 180.0


def circular_deviation(degrees: Column) -> Column:
    """sqrt(-2 ln R) in degrees; NULL of fewer than two angles."""
    good = F.when(~F.isnan(degrees), F.radians(degrees))
    c, s = _resultant(good)
    # Rounding may bring R above 1.
    return F.when(F.count(good) >= 2, F.degrees(F.sqrt(-2.0 * F.log(F.least(F.hypot(c, s), F.lit(1.0))))))


def circular_error(degrees: Column) -> Column:
    """The deviation over the square root of the count."""
    return circular_deviation(degrees) / F.sqrt(F.count(F.when(~F.isnan(degrees), degrees)))


def bootstrap(table: DataFrame, keys: list[str], column: str, statistic: str = "mean", draws: int = 200, alpha: float = 0.32, seed: int = 0) -> DataFrame:
    """(keys, value, low, high): the statistic ("mean", "rms" or "circular", degrees) with a bootstrap interval of 1 - alpha.

    Row r counts in draw d as often as a Poisson number of mean 1 that the hash of (keys, the row's task and place, d, seed) fixes. Each task adds up
    its draws' sums first, so a group of any size is never held in one place. Nulls and NaN take no part; a group without rows is absent.
    """
    x = F.col(column)
    # Equal rows draw apart by their places in their tasks, which needs no shuffle; another partitioning gives other draws.
    rows = table.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).select(*keys, x.cast("double").alias("_x")).withColumn("_id", F.monotonically_increasing_id())
    parts = {"mean": ("_x",), "rms": ("_x * _x",), "circular": ("cos(radians(_x))", "sin(radians(_x))")}[statistic]
    # Cumulative probabilities of a Poisson number of mean 1.
    steps = F.array(*[F.lit(float(x)) for x in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)])])
    draw = lambda d: (F.pmod(F.xxhash64(*keys, "_id", d, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    number = lambda d, u: F.when(d == 0, 1).otherwise(F.size(F.filter(steps, lambda s: u > s)))
    numbered = F.transform(F.sequence(F.lit(0), F.lit(draws)), lambda d: F.struct(d.alias("d"), draw(d).alias("u")))
    # Draw 0 is the data itself.
    each = rows.select(*keys, "_x", F.explode(F.transform(numbered, lambda s: F.struct(s["d"].alias("d"), number(s["d"], s["u"]).alias("w")))).alias("_z")).select(*keys, "_x", F.col("_z.d").alias("_d"), F.col("_z.w").alias("_w")).filter("_w > 0")
    sums = each.groupBy(*keys, "_d").agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.expr(p)).alias(f"_s{k}") for k, p in enumerate(parts)])
    value = {"mean": F.col("_s0") / F.nullif("_n", F.lit(0)), "rms": F.sqrt(F.col("_s0") / F.nullif("_n", F.lit(0)))}.get(statistic)
    if value is None:
        value = F.when(F.col("_n") > 0, F.degrees(F.atan2("_s1", "_s0")))
    found = sums.select(*keys, "_d", value.alias("_v")).groupBy(*keys).agg(F.max(F.when(F.col("_d") == 0, F.col("_v"))).alias("value"), F.collect_list(F.when(F.col("_d") > 0, F.col("_v"))).alias("_v"))
    if statistic == "circular":  # around the mean
        found = found.withColumn("_v", F.transform("_v", lambda v: F.pmod(v - F.col("value") + 180.0, F.lit(360.0)) - 180.0 + F.col("value")))
    ordered, n = F.sort_array("_v"), F.size("_v")
    at = lambda share: F.get(ordered, F.least(F.floor(n * share).cast("int"), n - 1))
    return found.select(*keys, "value", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def variation(table: DataFrame, keys: list[str], column: str, degrees: bool = False) -> DataFrame:
    """(keys, variation, n): mean size of the differences of consecutive values in time; angles are wrapped."""
    step = F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy("time"))
    if degrees:
        step = F.pmod(step + 180.0, F.lit(360.0)) - 180.0
    return table.withColumn("_d", F.abs(step)).filter("_d is not null").groupBy(*keys).agg(F.avg("_d").alias("variation"), F.count(F.lit(1)).alias("n"))


def compare_variation(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The median over keys of variation over the reference's."""
    both = one.join(other.select(*keys, F.col("variation").alias("_o")), keys)
    return both.agg(F.median(F.col("variation") / F.nullif("_o", F.lit(0.0))).alias("ratio"), F.count(F.lit(1)).alias("n"))


def diagonal_closures(closures: DataFrame, vis: DataFrame, kind: str = "cphase") -> DataFrame:
    """Closure phases (degrees) or log closure amplitudes of a time as independent combinations: (time, k, value, sigma).

    ``closures`` is a minimal set with stations t1, t2, t3 (and t4) and the column cphase or camp; ``vis`` gives each baseline's
    amplitude and sigma. The combinations are the eigenvectors of the closures' covariance, errors rising. A time has as many rows
    as the array has closures.
    """
    snr = F.hypot("vis_re", "vis_im") / F.col("sigma")
    noise = vis.groupBy("time").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", F.least("t1", "t2"), F.greatest("t1", "t2")), (1 / (snr * snr)).alias("v")))).alias("noise"))
    value, stations = ("cphase", ("t1", "t2", "t3")) if kind == "cphase" else ("camp", ("t1", "t2", "t3", "t4"))
    rows = closures.select("time", *stations, F.col(value).alias("value")).join(noise, "time")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        var = dict(rows["noise"].iloc[0])
        # Each closure is a signed sum over baselines: (12)(23)(31), or (12)(34)/(14)(23).
        legs = ((0, 1, 1), (1, 2, 1), (2, 0, 1)) if kind == "cphase" else ((0, 1, 1), (2, 3, 1), (0, 3, -1), (1, 2, -1))
        names = sorted(var)
        place = {b: k for k, b in enumerate(names)}
        design = np.zeros((len(rows), len(names)))
        for r, s in enumerate(rows[list(stations)].itertuples(index=False)):
            for a, b, sign in legs:
                turned = s[a] > s[b] and kind == "cphase"
                design[r, place["-".join(sorted((s[a], s[b])))]] += -sign if turned else sign
        size, vectors = np.linalg.eigh(design @ np.diag([var[b] for b in names]) @ design.T)
        scale = 180 / np.pi if kind == "cphase" else 1.0
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(size))] < 0, -1, 1)
        values = vectors.T @ rows["value"].to_numpy()
        return pd.DataFrame({"time": rows["time"].iloc[0], "k": np.arange(len(rows)), "value": values, "sigma": scale * np.sqrt(np.maximum(size, 0))})

    return rows.groupBy("time").applyInPandas(one, "time double, k long, value double, sigma double")
