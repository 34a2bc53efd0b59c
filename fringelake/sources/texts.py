"""Text formats: observing schedules, images, stations, gains, models and tables of closures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCSECOND = 3.141592653589793 / 180 / 3600


def _sectors(text: str) -> dict[str, str]:
    """The blocks of a schedule by name; comments (from an asterisk) are left out."""
    text = re.sub(r"^\s*\*.*$", "", text, flags=re.M)
    parts = re.split(r"^\$([A-Z_0-9]+)\s*;", text, flags=re.M)
    return dict(zip(parts[1::2], parts[2::2], strict=True))


def _definitions(sector: str, begin: str, end: str) -> list[tuple[str, str]]:
    return re.findall(rf"\b{begin}\s+([^;\s]+)\s*;(.*?)\b{end}\s*;", sector, flags=re.S)


def _field(body: str, name: str) -> str | None:
    found = re.search(rf"\b{name}\s*=\s*([^;]*);", body)
    return found[1].strip() if found else None


def _angle(text: str, hours: bool) -> float:
    """Hours or degrees of 12h30m49.4s or -29d00'28.1"."""
    parts = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", text)]
    size = sum(x / 60**k for k, x in enumerate(parts[:3]))
    return -size if text.strip().startswith("-") else size


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def schedule_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source, ra hours, dec degrees) of a schedule file."""
    rows = [(_field(b, "source_name") or n, _angle(_field(b, "ra") or "0", True), _angle(_field(b, "dec") or "0", False)) for n, b in _definitions(_sectors(_read(spark, path)).get("SOURCE", ""), "def", "enddef")]
    return spark.createDataFrame(rows, "source string, ra double, dec double")


def schedule_stations(spark: SparkSession, path: str, sefds: dict[str, float] | None = None, default: float = 10000.0) -> DataFrame:
    """(site, site_id, x, y, z, sefd) of a schedule file; sites without an entry in ``sefds`` have the default."""
    rows = []
    for name, body in _definitions(_sectors(_read(spark, path)).get("SITE", ""), "def", "enddef"):
        x = [float(v) for v in re.findall(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?", _field(body, "site_position") or "")] or [0.0, 0.0, 0.0]
        site = _field(body, "site_name") or name
        rows.append((site, _field(body, "site_ID") or name, *x[:3], float((sefds or {}).get(site, default))))
    return spark.createDataFrame(rows, "site string, site_id string, x double, y double, z double, sefd double")


def schedule_scans(spark: SparkSession, path: str) -> DataFrame:
    """(scan, source, mjd, hour, site_id, start, stop): one row a scan and station, times in seconds from the scan's start."""
    from ..functions.scalars import schedule_date

    rows = []
    for name, body in _definitions(_sectors(_read(spark, path)).get("SCHED", ""), "scan", "endscan"):
        for station in re.findall(r"\bstation\s*=\s*([^;]*);", body):
            f = [x.strip() for x in station.split(":")]
            seconds = [float(m[0]) if (m := re.findall(r"\d+(?:\.\d+)?", x)) else 0.0 for x in f[1:3]]
            rows.append((name, _field(body, "source") or "", _field(body, "start") or "", f[0], *seconds))
    table = spark.createDataFrame(rows, "scan string, source string, date string, site_id string, start double, stop double")
    mjd, hour = schedule_date(F.col("date"))
    return table.select("scan", "source", mjd.alias("mjd"), hour.alias("hour"), "site_id", "start", "stop")


def schedule_frequency(spark: SparkSession, path: str) -> tuple[float, float]:
    """(centre, width) in Hz of the last channel that a schedule defines."""
    found = re.findall(r"^\s*chan_def\s*=([^;]*);", _sectors(_read(spark, path)).get("FREQ", ""), flags=re.M)
    if not found:
        raise ValueError(f"{path}: no channel is defined")
    numbers = [float(x) for x in re.findall(r"(\d+(?:\.\d+)?)\s*MHz", found[-1])]
    return numbers[0] * 1e6, numbers[1] * 1e6


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image text files, one row a file: (path, source, nx, ny, psize, mjd, rf, ipix, qpix, upix, vpix); missing products are NULL.

    Lines hold x and y (arc seconds), I and, if there are any, Q, U and V, row by row; header lines begin with #.
    """
    lines = F.split("value", "\n")
    head = F.filter(lines, lambda x: F.trim(x).startswith("#"))
    body = F.transform(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), lambda x: F.split(F.trim(x), r"\s+"))
    entry = lambda k, g: F.regexp_extract(F.element_at(F.filter("head", lambda x: x.rlike(f"^#\\s*{k}:")), 1), f"{k}:\\s*{g}", 1)
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), head.alias("head"), body.alias("body"))
    number = r"([-+0-9.eE]+)"
    pixels = lambda k: F.when(F.size(F.get("body", F.lit(0))) > k, F.transform("body", lambda f: F.get(f, F.lit(k)).cast("double")))
    nx, ny = (entry(f"FOV{a}", r"([0-9]+)").cast("int") for a in "XY")
    field = entry("FOVX", r"[0-9]+ pix ([-+0-9.eE]+)").cast("double")
    return rows.select("path", F.trim(entry("SRC", "(.*)")).alias("source"), nx.alias("nx"), ny.alias("ny"), (field * ARCSECOND / nx).alias("psize"), entry("MJD", number).cast("double").alias("mjd"), (entry("RF", number).cast("double") * 1e9).alias("rf"), *[pixels(2 + k).alias(f"{s}pix") for k, s in enumerate("iquv")])


def image_text(source: Column, mjd: Column, rf: Column, nx: int, ny: int, psize: float, *planes: str) -> Column:
    """The text of one image whose arrays are the named columns."""
    step = psize / ARCSECOND
    head = F.concat(F.lit("# SRC: "), source, F.lit("\n# RA: 00 h 00 m 0.0000 s\n# DEC: 00 deg 00 m 0.0000 s\n# MJD: "), F.format_string("%.6f", mjd), F.lit("\n# RF: "), F.format_string("%.4f", rf / 1e9), F.lit(f" GHz\n# FOVX: {nx} pix {step * nx:.17g} as\n# FOVY: {ny} pix {step * ny:.17g} as\n# ------------------------------------\n# x (as)     y (as)       I (Jy/pixel)\n"))

    def line(i: Column) -> Column:
        x, y = (nx / 2 - F.pmod(i, F.lit(nx)) - 1) * step, (ny / 2 - F.floor(i / nx) - 1) * step
        return F.concat_ws(" ", *[F.format_string("%.17g", v) for v in (x, y, *(F.get(p, i).cast("double") for p in planes))])

    return F.concat(head, F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), line)))


def write_lines(table: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as lines of the columns with a space between; numbers keep all digits, nulls are nan."""
    values = [F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.17g", c) if t == "double" else F.col(c).cast("string")) for c, t in table.select(*columns).dtypes]
    table.select(F.concat_ws(" ", *values).alias("value")).write.text(path)


#: Columns of each kind of table: names, then numbers.
TABLES = {
    "amp": (("t1", "t2"), ("u", "v", "amp", "sigma")),
    "bs": (("t1", "t2", "t3"), ("u1", "v1", "u2", "v2", "u3", "v3", "bispec_re", "bispec_im", "sigmab")),
    "cphase": (("t1", "t2", "t3"), ("u1", "v1", "u2", "v2", "u3", "v3", "cphase", "sigmacp")),
    "camp": (("t1", "t2", "t3", "t4"), ("u1", "v1", "u2", "v2", "u3", "v3", "u4", "v4", "camp", "sigmaca")),
    "logcamp": (("t1", "t2", "t3", "t4"), ("u1", "v1", "u2", "v2", "u3", "v3", "u4", "v4", "camp", "sigmaca")),
}


def write_table(table: DataFrame, path: str, kind: str) -> None:
    """A closure or amplitude table as text: time, stations, coordinates, value and error."""
    names, numbers = TABLES[kind]
    write_lines(table, path, ["time", *names, *numbers])


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table written so; a line of another width, or a word that is no number (or nan), gives nulls."""
    names, numbers = TABLES[kind]
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"))
    whole = F.size("f") == 1 + len(names) + len(numbers)
    get = lambda k: F.when(whole, F.get("f", F.lit(k)))
    number = lambda k: F.when(~F.isnan(get(k).try_cast("double")), get(k).try_cast("double"))
    return rows.select(number(0).alias("time"), *[get(k).alias(n) for k, n in enumerate(names, 1)], *[number(k).alias(n) for k, n in enumerate(numbers, 1 + len(names))])


STATION_COLUMNS = ["site", "x", "y", "z", "sefdr", "sefdl", "fr_par", "fr_elev", "fr_off", "dr_re", "dr_im", "dl_re", "dl_im"]


def write_stations(stations: DataFrame, path: str) -> None:
    """Stations in the 13 columns that the reader takes."""
    write_lines(stations, path, STATION_COLUMNS)


def write_gains(gains: DataFrame, path: str, square: bool = False) -> None:
    """One folder ``site=<name>`` a site with lines of time and the parts of both gains (squared if asked)."""
    columns = ["r_re", "r_im", "l_re", "l_im"]
    if square:
        gains = gains.withColumns({f"{h}_{p}": e for h in "rl" for p, e in (("re", F.col(f"{h}_re") * F.col(f"{h}_re") - F.col(f"{h}_im") * F.col(f"{h}_im")), ("im", 2 * F.col(f"{h}_re") * F.col(f"{h}_im")))})
    line = F.concat_ws(" ", *[F.format_string("%.17g", F.col(c)) for c in ("time", *columns)])
    gains.repartition("site").sortWithinPartitions("site", "time").select("site", line.alias("value")).write.partitionBy("site").text(path)


def read_models(spark: SparkSession, path: str) -> list:
    """Components of a model text file: a kind, then name=value pairs (beta as comma-separated complex numbers) a line."""
    from ..operators.models import Component

    out = []
    for (text,) in spark.read.text(path).collect():
        words = text.split("#")[0].split()
        if words:
            given = dict(w.split("=", 1) for w in words[1:])
            beta = tuple(complex(z) for z in given.pop("beta", "").split(",") if z)
            out.append(Component(words[0], beta=beta, **{k: float(v) for k, v in given.items()}))
    return out


def model_lines(components: list) -> list[str]:
    """Lines that ``read_models`` takes."""
    from dataclasses import asdict

    lines = []
    for c in components:
        values = asdict(c)
        kind, beta = values.pop("kind"), values.pop("beta")
        lines.append(" ".join([kind, *(f"{k}={v!r}" for k, v in values.items()), *([f"beta={','.join(str(z).strip('()') for z in beta)}"] if beta else [])]))
    return lines
