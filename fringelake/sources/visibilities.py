"""The visibility table: from the synthetic star schema, and from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIS = """
with r as (
 select {day} as dayno, cast(l_suppkey % 6 as int) a, cast(l_partkey % 6 as int) b, l_orderkey ok, l_linenumber ln,
        l_extendedprice/1e4 amp, 6.283185307179586e0*(l_discount*7e0+l_tax*3e0) + l_extendedprice/1e3 ph, 5e-2+l_tax+l_quantity/5e2 sg
 from {lineitem} where l_suppkey % 6 <> l_partkey % 6),
k as (select *, least(a,b) i, greatest(a,b) j, row_number() over (partition by dayno, least(a,b), greatest(a,b) order by ok, ln) rn from r),
c as (select *, (cast(dayno as double) + 3e1*floor(cast(dayno as double)/6e1))*1e1/3.6e3 as time from k where rn=1),
g as (select *, 2.617993877991494e-1*time th from c)
select cast(dayno as bigint) dayno, time, 1e1 as tint, concat('S',cast(i as string)) t1, concat('S',cast(j as string)) t2, 1e-1 tau1, 1e-1 tau2,
 round(1e9*(i*i*1.1e-1*cos(th)+i*3.7e-1*sin(th)),0)-round(1e9*(j*j*1.1e-1*cos(th)+j*3.7e-1*sin(th)),0) u,
 round(1e9*(i*2.9e-1*cos(th)-i*i*7e-2*sin(th)),0)-round(1e9*(j*2.9e-1*cos(th)-j*j*7e-2*sin(th)),0) v,
 round(amp*cos(ph),9) vis_re, round(amp*sin(ph),9) vis_im, sg as sigma
from g"""
ORACLE_VIS = VIS.replace("{day}", "date_diff('day', date '1995-01-01', cast(l_shipdate as date))").replace("{lineitem}", "lineitem")
TEXT_COLUMNS = ("time", "tint", "t1", "t2", "tau1", "tau2", "u", "v", "iamp", "iphase", "qamp", "qphase", "uamp", "uphase", "vamp", "vphase", "sigma", "qsigma", "usigma", "vsigma")


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a time and baseline, Stokes I only."""
    text = VIS.replace("{day}", "datediff(cast(l_shipdate as date), date '1995-01-01')")
    return spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Visibility text files of 20 columns, or of the older 19, 17 or 15; amplitudes and phases (degrees) become complex pairs.

    Older files have tau in columns 7 and 8, one sigma for all products, and lack V (17) or all but I (15), which are 0.
    A line of another width gives nulls.
    """
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"), F.size(f).alias("n"))
    get = lambda i: F.get("f", F.lit(i))
    new, old = F.col("n") == 20, F.col("n").isin(15, 17, 19)
    number = lambda now, then: F.when(new, get(now).cast("double")).when(old, get(then).cast("double"))
    columns = [get(0).cast("double").alias("time"), get(1).cast("double").alias("tint"), get(2).alias("t1"), get(3).alias("t2")]
    columns += [number(now, then).alias(c) for c, now, then in (("tau1", 4, 6), ("tau2", 5, 7), ("u", 6, 8), ("v", 7, 9))]
    for k, name in enumerate(("vis", "qvis", "uvis", "vvis")):
        has = old & (F.col("n") >= (15, 17, 17, 19)[k])
        size = F.when(new, get(8 + 2 * k).cast("double")).when(has, get(10 + 2 * k).cast("double")).when(old, F.lit(0.0))
        angle = F.radians(F.when(new, get(9 + 2 * k).cast("double")).when(has, get(11 + 2 * k).cast("double")).when(old, F.lit(0.0)))
        columns += [(size * F.cos(angle)).alias(f"{name}_re"), (size * F.sin(angle)).alias(f"{name}_im")]
    # Of 15 columns the sigma is the thirteenth, else the last.
    one = F.when(F.col("n") == 15, get(12)).otherwise(F.get("f", F.col("n") - 1)).cast("double")
    columns += [F.when(new, get(16 + k).cast("double")).when(old, one).alias(c) for k, c in enumerate(("sigma", "qsigma", "usigma", "vsigma"))]
    return rows.select(*columns)


def read_flags(spark: SparkSession, path: str, kind: str = "station") -> DataFrame:
    """(start, stop, site) in hours of the day, from CSV files with mjd_start, mjd_stop and a column named ``kind`` ("station" or "baseline"; "all" has none)."""
    rows = spark.read.option("header", True).csv(path)
    hours = lambda c: F.pmod(F.col(c).cast("double"), F.lit(1.0)) * 24.0
    what = F.lit(None).cast("string") if kind == "all" else F.trim(kind)
    return rows.select(hours("mjd_start").alias("start"), hours("mjd_stop").alias("stop"), what.alias("site"))


def write_text(vis: DataFrame, path: str) -> None:
    columns = []
    for n in TEXT_COLUMNS:
        if n.endswith(("amp", "phase")):
            name = {"i": "vis", "q": "qvis", "u": "uvis", "v": "vvis"}[n[0]]
            re, im = (F.col(f"{name}_{x}") if f"{name}_{x}" in vis.columns else F.lit(0.0) for x in ("re", "im"))
            columns.append(F.format_string("%.17g", F.hypot(re, im) if n.endswith("amp") else F.degrees(F.atan2(im, re))))
        elif n in vis.columns:
            columns.append(F.col(n) if n in ("t1", "t2") else F.format_string("%.17g", F.col(n).cast("double")))
        else:
            columns.append(F.lit("0"))
    vis.select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station text files of 5 or 13 columns."""
    f = F.split(F.trim("value"), r"\s+")
    names = ("x", "y", "z", "sefdr", "sefdl", "fr_par", "fr_elev", "fr_off", "dr_re", "dr_im", "dl_re", "dl_im")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"))
    full = F.size("f") >= 13
    columns = [F.get("f", F.lit(i + 1)).cast("double") if i < 4 else F.when(full, F.get("f", F.lit(i + 1)).cast("double")).otherwise(F.get("f", F.lit(4)).cast("double") if i == 4 else F.lit(0.0)) for i in range(12)]
    return rows.select(F.get("f", F.lit(0)).alias("site"), *[c.alias(n) for c, n in zip(columns, names, strict=True)])


def read_gains(spark: SparkSession, path: str, square_root: bool = False) -> DataFrame:
    """One text file a site: time, then R and L gains as real and imaginary parts (or R and L real)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/_.]+)[^/]*$", 1).alias("site"), f.alias("f")).filter(F.get("f", F.lit(0)) != "")
    get = lambda i: F.get("f", F.lit(i)).cast("double")
    wide = F.size("f") >= 5
    out = rows.select("site", get(0).alias("time"), get(1).alias("r_re"), F.when(wide, get(2)).otherwise(0.0).alias("r_im"), F.when(wide, get(3)).otherwise(get(2)).alias("l_re"), F.when(wide, get(4)).otherwise(0.0).alias("l_im"))
    if not square_root:
        return out
    columns = {}
    for hand in "rl":  # the principal root of a complex number
        re, im = F.col(f"{hand}_re"), F.col(f"{hand}_im")
        size, turn = F.sqrt(F.hypot(re, im)), F.atan2(im, re) / 2
        columns |= {f"{hand}_re": size * F.cos(turn), f"{hand}_im": size * F.sin(turn)}
    return out.withColumns(columns)
