"""Arrangement of visibility tables: canonical order, groups by time and baseline, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import gmst
from .visibility import BASELINE, conjugate_row


def canonical(vis: DataFrame) -> DataFrame:
    """Baselines with their stations in order; turned rows are conjugated."""
    turned = F.struct(*conjugate_row(vis.columns))
    return vis.select(F.when(F.col("t1") > F.col("t2"), turned).otherwise(F.struct(*vis.columns)).alias("x")).select("x.*")


def time_groups(vis: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(group, t_start, t_stop, n) of equal times, or of times within chunks of ``seconds``."""
    group = F.col("time") if seconds <= 0 else (F.col("time") / (seconds / 3600.0)).cast("long")
    return vis.groupBy(group.alias("group")).agg(F.min("time").alias("t_start"), F.max("time").alias("t_stop"), F.count(F.lit(1)).alias("n"))


def baseline_groups(vis: DataFrame) -> DataFrame:
    """(t1, t2, n, t_start, t_stop, tint) of each unordered baseline."""
    return vis.groupBy(F.least(*BASELINE).alias("t1"), F.greatest(*BASELINE).alias("t2")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("t_start"), F.max("time").alias("t_stop"), F.sum("tint").alias("tint"))


def nearest_scan(vis: DataFrame, scans: DataFrame, time: float) -> DataFrame:
    """The rows of the scan whose start is nearest to ``time``, the first of equals."""
    best = scans.agg(F.min_by(F.struct("t_start", "t_stop"), F.struct(F.abs(F.col("t_start") - time), "t_start")).alias("s")).select("s.*")
    return vis.crossJoin(F.broadcast(best)).filter(F.col("time").between(F.col("t_start"), F.col("t_stop"))).drop("t_start", "t_stop")


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several tables; columns that one lacks are missing there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def split_by_time(vis: DataFrame, seconds: float) -> DataFrame:
    """Rows with the number of their time chunk, as a column to partition output by."""
    return vis.withColumn("chunk", (F.col("time") / (seconds / 3600.0)).cast("long"))


def subarray(vis: DataFrame, sites: list[str]) -> DataFrame:
    """Rows whose stations both belong to ``sites``."""
    return vis.filter(F.col("t1").isin(*sites) & F.col("t2").isin(*sites))


def every_nth(vis: DataFrame, n: int, hours: float = 24.0) -> DataFrame:
    """Rows at every ``n``-th distinct time of the table, the first included.

    Times are numbered within blocks of ``hours``; only a row a block meets a window over all.
    """
    from pyspark.sql import Window

    times = vis.select("time").distinct().withColumn("_block", F.floor(F.col("time") / hours))
    sizes = times.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_block").orderBy("time")) - 1
    kept = times.withColumn("_at", at).join(base, "_block").filter((F.col("_base") + F.col("_at")) % n == 0).select("time")
    return vis.join(kept, "time", "left_semi").select(*vis.columns)


def pick(vis: DataFrame, sites: list[str]) -> DataFrame:
    """Rows at the times at which every one of ``sites`` takes part; all rows if there are none."""
    if not sites:
        return vis
    full = vis.groupBy("time").agg(*[F.max((F.col("t1") == s) | (F.col("t2") == s)).alias(f"_{i}") for i, s in enumerate(sites)])
    for i in range(len(sites)):
        full = full.filter(f"_{i}")
    return vis.join(full.select("time"), "time", "left_semi").select(*vis.columns)


def merge_observations(observations: list[tuple[DataFrame, int]]) -> DataFrame:
    """All rows of (table, mjd) pairs as one table: hours since the first day's midnight, stations in order, one row a time and baseline.

    Of rows with one time and baseline the one with the least sigma stays, then the first by its visibility.
    """
    from pyspark.sql import Window

    day = min(mjd for _, mjd in observations)
    moved = [canonical(t).withColumn("time", F.col("time") + 24.0 * (mjd - day)) for t, mjd in observations]
    order = Window.partitionBy("time", *BASELINE).orderBy(F.col("sigma").asc_nulls_last(), "vis_re", "vis_im")
    return merge(*moved).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def merge_stations(*tables: DataFrame) -> DataFrame:
    """Distinct rows of several station tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def common_rows(a: DataFrame, b: DataFrame, tolerance: float, by: str = "ut", once: bool = False, offset: float = 0.0, days: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``a`` whose key ``b`` has too: baseline with time ("ut"), with sidereal time ("gmst"), or with the projected length
    ("uvdist"), all to ``tolerance``. Sidereal time is that of each table's day (``days``, modified Julian), or without days a clock of
    sidereal rate, shifted by ``offset`` hours for ``b``. ``once`` keeps the first row of a key."""
    from pyspark.sql import Window

    sidereal = 1.0027379093507951
    value = {"ut": lambda o: F.col("time"), "gmst": lambda o: F.pmod(F.col("time") * sidereal + o, F.lit(24.0)), "uvdist": lambda o: F.hypot("u", "v")}[by]
    keys = ["_k", "_a", "_b"]
    clock = lambda o, day: gmst(F.col("time"), day) if by == "gmst" and day is not None else value(o)
    keyed = lambda t, o, day: t.withColumns({"_k": F.rint(clock(o, day) / tolerance), "_a": F.least(*BASELINE), "_b": F.greatest(*BASELINE)})
    found = keyed(a, 0.0, days and days[0]).join(keyed(b, offset, days and days[1]).select(*keys).distinct(), keys, "left_semi")
    if once:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("time", *BASELINE))).filter("_n = 1").drop("_n")
    return found.drop(*keys)


def station_clusters(stations: DataFrame, reach: float) -> DataFrame:
    """(site, cluster): in order of name, a station within ``reach`` metres of a cluster's first member joins it, else it begins one."""
    firsts: list[tuple[float, float, float]] = []
    out = []
    for r in sorted(stations.select("site", "x", "y", "z").collect()):  # one row a telescope
        place = (r["x"], r["y"], r["z"])
        near = next((k for k, p in enumerate(firsts) if sum((m - n) ** 2 for m, n in zip(p, place, strict=True)) <= reach**2), None)
        if near is None:
            near = len(firsts)
            firsts.append(place)
        out.append((r["site"], near))
    return stations.sparkSession.createDataFrame(out, "site string, cluster int")


def joined_products(spark, paths: dict[str, str]) -> DataFrame:
    """Simulator text files of one product each (i, q, u, v): lines of time, t1, t2, u, v, re, im, sigma, joined by time and baseline.

    A product whose file lacks the row is NULL.
    """
    out, names = None, {"i": "vis", "q": "qvis", "u": "uvis", "v": "vvis"}
    for product, path in paths.items():
        f = F.split(F.trim("value"), r"[\s,]+")
        rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"))
        number = lambda k: F.get("f", F.lit(k)).try_cast("double")
        sigma = "sigma" if product == "i" else f"{product}sigma"
        one = rows.select(number(0).alias("time"), F.get("f", F.lit(1)).alias("t1"), F.get("f", F.lit(2)).alias("t2"), number(3).alias("u"), number(4).alias("v"), number(5).alias(f"{names[product]}_re"), number(6).alias(f"{names[product]}_im"), number(7).alias(sigma))
        out = one if out is None else out.join(one.drop("u", "v"), ["time", "t1", "t2"], "left")
    return out
