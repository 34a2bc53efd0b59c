"""FITS files: random-group visibility files, read by byte ranges, and images.

A visibility file's header and small tables are read by the driver; its groups
are read by tasks, each of its own byte range, so a file of any size is read in
parallel. The path must be one that executors can open.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

BLOCK, CARD = 2880, 80
#: Bytes of groups that a task reads, and that it holds at a time.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Fixed values of the format: numbers of each BITPIX, cells of each TFORM letter.
NUMBERS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
CELLS = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
PRODUCTS = {"circ": (("rrvis", "rrsigma"), ("llvis", "llsigma"), ("rlvis", "rlsigma"), ("lrvis", "lrsigma")), "stokes": (("vis", "sigma"), ("qvis", "qsigma"), ("uvis", "usigma"), ("vvis", "vsigma"))}
JD = 2400000.5
DEGREE = math.pi / 180


@dataclass(frozen=True)
class Unit:
    """One header with the place of its data."""

    header: dict
    start: int
    size: int

    def axes(self) -> list[int]:
        return [self.header[f"NAXIS{k}"] for k in range(1, self.header.get("NAXIS", 0) + 1)]


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'?", text)[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def units(data) -> list[Unit]:
    """All units of an open binary file."""
    found = []
    data.seek(0, os.SEEK_END)
    end, at = data.tell(), 0
    while at < end:
        header: dict = {}
        data.seek(at)
        done = False
        while not done:
            block = data.read(BLOCK)
            if len(block) < BLOCK:
                return found
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD].decode("ascii", "replace")
                name = card[:8].strip()
                if name == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    header.setdefault(name, _value(card[10:]))
        axes = [header[f"NAXIS{k}"] for k in range(1, header.get("NAXIS", 0) + 1)]
        if header.get("GROUPS") is True and axes and axes[0] == 0:
            axes = axes[1:]
        count = header.get("GCOUNT", 1) * (header.get("PCOUNT", 0) + math.prod(axes)) if axes else 0
        size = abs(header.get("BITPIX", 8)) // 8 * count
        found.append(Unit(header, data.tell(), size))
        at = data.tell() + -(-size // BLOCK) * BLOCK
    return found


def _rows(data, unit: Unit) -> np.ndarray:
    """A binary table."""
    fields = []
    for k in range(1, unit.header["TFIELDS"] + 1):
        n, letter = re.match(r"(\d*)([A-Z])", unit.header[f"TFORM{k}"]).groups()
        n = int(n) if n else 1
        kind = f"S{n}" if letter == "A" and n else CELLS.get(letter, ">u1")
        name = unit.header.get(f"TTYPE{k}", f"c{k}")
        fields.append((name, kind) if letter == "A" and n or n == 1 else (name, kind, (n,)))
    data.seek(unit.start)
    dtype = np.dtype(fields)
    return np.frombuffer(data.read(dtype.itemsize * unit.header["NAXIS2"]), dtype)


@dataclass(frozen=True)
class Observation:
    """What a visibility file says of itself: ra in hours, dec in degrees, rf and bw in Hz."""

    source: str
    ra: float
    dec: float
    rf: float
    bw: float
    polrep: str


def _named(found: list[Unit], name: str) -> Unit | None:
    return next((u for u in found if u.header.get("EXTNAME") == name), None)


def _axis(header: dict, name: str) -> int | None:
    return next((k for k in range(1, header["NAXIS"] + 1) if str(header.get(f"CTYPE{k}", "")).strip() == name), None)


def observation(path: str) -> Observation:
    with open(path, "rb") as data:
        found = units(data)
    h = found[0].header
    ra_at, dec_at, freq, stokes, band = (_axis(h, n) for n in ("RA", "DEC", "FREQ", "STOKES", "IF"))
    if freq is None or stokes is None or not h.get("GROUPS"):
        raise ValueError(f"{path}: no random groups with STOKES and FREQ axes")
    ra = float(h["OBSRA"] if "OBSRA" in h else h[f"CRVAL{ra_at}"]) * 12 / 180
    dec = float(h["OBSDEC"] if "OBSDEC" in h else h[f"CRVAL{dec_at}"])
    antennas = _named(found, "AIPS AN")
    rf = float((antennas.header if antennas else {}).get("FREQ", h[f"CRVAL{freq}"]))
    first = float(h[f"CRVAL{stokes}"])
    if first not in (1.0, -1.0):
        raise ValueError(f"{path}: products begin at {first}, neither Stokes I nor RR")
    width = float(h[f"CDELT{freq}"]) * h[f"NAXIS{freq}"] * (h[f"NAXIS{band}"] if band else 1)
    return Observation(str(h.get("OBJECT", "")), ra, dec, rf, width, "stokes" if first == 1.0 else "circ")


STATIONS = "number int, site string, x double, y double, z double, sefdr double, sefdl double"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Numbered stations of a visibility file, at most 255 by its format."""
    with open(path, "rb") as data:
        unit = _named(units(data), "AIPS AN")
        rows = _rows(data, unit)
    sefd = rows["SEFD"] if "SEFD" in rows.dtype.names else np.zeros(len(rows))
    out = [(int(r["NOSTA"]), r["ANNAME"].decode().strip(), *(float(x) for x in r["STABXYZ"]), float(s), float(s)) for r, s in zip(rows, sefd, strict=True)]
    return spark.createDataFrame(out, STATIONS)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """(t_start, t_stop) in hours of the file's scans; none without an index table."""
    out = []
    with open(path, "rb") as data:
        unit = _named(units(data), "AIPS NX")
        if unit is not None:
            out = [(24.0 * (float(r["TIME"]) - 0.5 * float(r["TIME INTERVAL"])), 24.0 * (float(r["TIME"]) + 0.5 * float(r["TIME INTERVAL"]))) for r in _rows(data, unit)]
    return spark.createDataFrame(out, "t_start double, t_stop double")


def _parameters(header: dict, date_zero: bool) -> list[tuple[str, float, float]]:
    """(name, scale, zero); the second of two equal names has a leading underscore."""
    out: list[tuple[str, float, float]] = []
    for k in range(1, header["PCOUNT"] + 1):
        name = str(header.get(f"PTYPE{k}", "")).strip()
        name = {"UU": "u", "VV": "v"}.get(name.split("-")[0], name)
        if any(n == name for n, _, _ in out):
            name = "_" + name
        zero = float(header.get(f"PZERO{k}", 0.0))
        out.append((name, float(header.get(f"PSCAL{k}", 1.0)), zero if date_zero or name not in ("DATE", "_DATE") else 0.0))
    return out


def read_uvfits(spark: SparkSession, path: str, channels: list[int] | None = None, bands: list[int] | None = None, inverse_variance: bool = True, flip: bool = False, fill_sigmas: bool = False, date_zero: bool = False) -> DataFrame:
    """Visibilities of a random-group file, in the products that it holds; a product without positive weight is NULL.

    Channels and bands (all, or those given) are averaged by weight, or plainly. Rows whose parallel hands
    (of Stokes files: I) have no weight are left out. ``fill_sigmas`` gives missing errors of circular
    products those of the other hand, then RR's. ``date_zero`` applies the offsets of the DATE parameters.
    Times are hours since the midnight of the first row's day, which column mjd names.
    """
    seen = observation(path)
    with open(path, "rb") as data:
        unit = units(data)[0]
    h = unit.header
    shape = unit.axes()[1:]
    number = np.dtype(NUMBERS[h["BITPIX"]])
    width = h["PCOUNT"] + math.prod(shape)
    names = _parameters(h, date_zero)
    axes = [_axis(h, n) for n in ("IF", "FREQ", "STOKES", "COMPLEX")]
    n_if, n_chan, n_prod, n_part = (h[f"NAXIS{a}"] if a else 1 for a in axes)
    for asked, have in ((channels, n_chan), (bands, n_if)):
        if asked is not None and (not asked or min(asked) < 0 or max(asked) >= have):
            raise ValueError("the specified channel or band does not exist")
    products = PRODUCTS[seen.polrep]
    scale, zero = float(h.get("BSCALE", 1.0)), float(h.get("BZERO", 0.0))
    a_task, a_batch = (max(1, n // (width * number.itemsize)) for n in (TASK_BYTES, BATCH_BYTES))
    tasks = -(-h["GCOUNT"] // a_task)
    base = ["_day", "_fraction", "tint", "tau1", "tau2", "u", "v"]
    doubles = base + [c for vis, sigma in products for c in (f"{vis}_re", f"{vis}_im", sigma)]
    schema = StructType([StructField("_t1", IntegerType()), StructField("_t2", IntegerType()), *(StructField(c, DoubleType()) for c in doubles)])
    sign = -1.0 if flip else 1.0

    def decode(raw: np.ndarray) -> pa.RecordBatch:
        n = len(raw)
        par = {name: raw[:, k].astype(float) * s + z for k, (name, s, z) in enumerate(names)}
        cube = raw[:, h["PCOUNT"] :].astype(float).reshape(n, *reversed(shape)) * scale + zero
        order = [len(shape) + 2 - a for a in axes if a]  # axis k of the file is axis N + 1 - k here
        rest = [d for d in range(1, cube.ndim) if d not in order]
        cube = cube.transpose(0, *order, *rest).reshape(n, n_if, n_chan, n_prod, n_part, -1)[..., 0]
        if bands is not None:
            cube = cube[:, bands]
        if channels is not None:
            cube = cube[:, :, channels]
        out, usable = {}, []
        with np.errstate(all="ignore"):
            for k, (vis, sigma) in enumerate(products):
                z = cube[:, :, :, k, 0] + 1j * cube[:, :, :, k, 1] if k < n_prod else np.zeros(cube.shape[:3], complex)
                w = np.nan_to_num(cube[:, :, :, k, 2]) if k < n_prod else np.zeros(cube.shape[:3])
                good = w > 0
                z, w, count = np.where(good, z, 0), np.where(good, w, 0), good.sum((1, 2))
                if inverse_variance:
                    mean, error = (z * w).sum((1, 2)) / w.sum((1, 2)), 1 / np.sqrt(w.sum((1, 2)))
                else:
                    mean, error = z.sum((1, 2)) / count, np.sqrt(np.where(good, 1 / w, 0).sum((1, 2))) / count
                usable.append(count > 0)
                for c, x in ((f"{vis}_re", mean.real), (f"{vis}_im", mean.imag), (sigma, error)):
                    out[c] = np.where(count > 0, x, np.nan)
        keep = usable[0] if seen.polrep == "stokes" else usable[0] | usable[1]
        code = par["BASELINE"].astype(int)
        none = np.zeros(n)
        out |= {"_day": par["DATE"], "_fraction": par.get("_DATE", none), "tint": par.get("INTTIM", none), "tau1": par.get("TAU1", none), "tau2": par.get("TAU2", none)}
        out |= {"u": sign * par["u"] * seen.rf, "v": sign * par["v"] * seen.rf}
        columns = [pa.array((code // 256)[keep].astype("int32")), pa.array((code % 256)[keep].astype("int32"))]
        columns += [pa.array(out[c][keep], from_pandas=True) for c in doubles]
        return pa.RecordBatch.from_arrays(columns, ["_t1", "_t2", *doubles])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as data:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    at, stop = task * a_task, min((task + 1) * a_task, h["GCOUNT"])
                    while at < stop:
                        n = min(a_batch, stop - at)
                        data.seek(unit.start + at * width * number.itemsize)
                        yield decode(np.frombuffer(data.read(n * width * number.itemsize), number).reshape(n, width))
                        at += n

    rows = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, schema)
    first = rows.agg(F.min(F.col("_day") + F.col("_fraction"))).first()[0]
    mjd = 0 if first is None else int(first - JD)
    sites = F.broadcast(read_stations(spark, path).select("number", "site"))
    for k in (1, 2):
        rows = rows.join(sites.select(F.col("number").alias(f"_t{k}"), F.col("site").alias(f"t{k}")), f"_t{k}")
    if fill_sigmas and seen.polrep == "circ":
        rows = rows.withColumns({"rrsigma": F.coalesce("rrsigma", "llsigma"), "llsigma": F.coalesce("llsigma", "rrsigma"), "rlsigma": F.coalesce("rlsigma", "rrsigma", "llsigma"), "lrsigma": F.coalesce("lrsigma", "rrsigma", "llsigma")})
    time = ((F.col("_day") - (JD + mjd)) + F.col("_fraction")) * 24.0
    return rows.select(F.lit(mjd).alias("mjd"), time.alias("time"), "tint", "t1", "t2", "tau1", "tau2", "u", "v", *doubles[len(base) :])


def _card(name: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value):>20.13E}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{name:<8}= {text}".ljust(CARD)[:CARD].encode("ascii")


def _header(cards: list[tuple[str, object]]) -> bytes:
    out = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(CARD)
    return out.ljust(-(-len(out) // BLOCK) * BLOCK)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % BLOCK)


def _table_bytes(name: str, columns: list[tuple[str, str, np.ndarray]], more: list[tuple[str, object]]) -> bytes:
    """A binary table of (name, form, values)."""
    fields = []
    for label, form, values in columns:
        n, letter = re.match(r"(\d+)([A-Z])", form).groups()
        fields.append((label, f"S{n}") if letter == "A" else (label, CELLS[letter]) if n == "1" else (label, CELLS[letter], (int(n),)))
    rows = np.zeros(len(columns[0][2]), np.dtype(fields))
    for label, _, values in columns:
        rows[label] = values
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("EXTNAME", name), ("EXTVER", 1)]
    cards += [(f"{key}{k}", value) for k, (label, form, _) in enumerate(columns, 1) for key, value in (("TTYPE", label), ("TFORM", form))]
    return _header(cards + more) + _padded(rows.tobytes())


def write_uvfits(vis: DataFrame, stations: DataFrame, path: str, seen: Observation, mjd: int, scans: DataFrame | None = None) -> None:
    """A random-group file of circular or Stokes products (``seen.polrep``), in order of time, with station and scan tables.

    Stations (site, x, y, z, sefdr) are numbered by name, 255 at most. One task writes the groups batch by batch
    into a file that takes the name ``path`` when whole. Missing products have weight 0.
    """
    places = sorted(stations.select("site", "x", "y", "z", "sefdr").collect())
    if len(places) > 255:
        raise ValueError("the format has room for 255 stations")
    spark = vis.sparkSession
    numbers = F.broadcast(spark.createDataFrame([(p["site"], k) for k, p in enumerate(places, 1)], "site string, number int"))
    parts = [c for v, s in PRODUCTS[seen.polrep] for c in (f"{v}_re", f"{v}_im", s)]
    rows = vis
    for k in (1, 2):
        rows = rows.join(numbers.select(F.col("site").alias(f"t{k}"), F.col("number").alias(f"_n{k}")), f"t{k}")
    missing = [c for c in parts if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in missing}).select("time", "tint", "tau1", "tau2", "u", "v", "_n1", "_n2", *parts)
    count = rows.count()
    shape = [3, 4, 1, 1, 1, 1]
    head: list[tuple[str, object]] = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 7), ("NAXIS1", 0), *((f"NAXIS{k}", n) for k, n in enumerate(shape, 2)), ("EXTEND", True), ("GROUPS", True), ("PCOUNT", 9), ("GCOUNT", count)]
    head += [("OBJECT", seen.source), ("OBSRA", seen.ra * 15.0), ("OBSDEC", seen.dec), ("MJD", float(mjd)), ("BUNIT", "JY"), ("EQUINOX", "J2000"), ("BSCALE", 1.0), ("BZERO", 0.0)]
    step = -1.0 if seen.polrep == "circ" else 1.0
    for k, (name, value, delta) in enumerate((("COMPLEX", 1.0, 1.0), ("STOKES", step, step), ("FREQ", seen.rf, seen.bw), ("IF", 1.0, 1.0), ("RA", seen.ra * 15.0, 1.0), ("DEC", seen.dec, 1.0)), 2):
        head += [(f"CTYPE{k}", name), (f"CRVAL{k}", value), (f"CDELT{k}", delta), (f"CRPIX{k}", 1.0), (f"CROTA{k}", 0.0)]
    for k, name in enumerate(("UU---SIN", "VV---SIN", "WW---SIN", "BASELINE", "DATE", "DATE", "INTTIM", "TAU1", "TAU2"), 1):
        head += [(f"PTYPE{k}", name), (f"PSCAL{k}", 1.0), (f"PZERO{k}", 0.0)]
    start = _header(head)
    no = np.arange(1, len(places) + 1)
    xyz = np.array([[p["x"], p["y"], p["z"]] for p in places], float).reshape(-1, 3)
    tail = _table_bytes("AIPS AN", [("ANNAME", "8A", np.array([p["site"].encode() for p in places])), ("STABXYZ", "3D", xyz), ("NOSTA", "1J", no), ("SEFD", "1E", np.array([p["sefdr"] for p in places], float))], [("FREQ", seen.rf), ("ARRNAM", "ARRAY"), ("TIMSYS", "UTC")])
    tail += _table_bytes("AIPS FQ", [("FRQSEL", "1J", np.ones(1)), ("IF FREQ", "1D", np.zeros(1)), ("CH WIDTH", "1E", np.array([seen.bw])), ("TOTAL BANDWIDTH", "1E", np.array([seen.bw])), ("SIDEBAND", "1J", np.ones(1))], [("NO_IF", 1)])
    if scans is not None:
        # The first and last row of each scan, counted in order of time.
        bounds = np.array([(s["t_start"], s["t_stop"]) for s in scans.select("t_start", "t_stop").orderBy("t_start").collect()], float).reshape(-1, 2)
        small = F.broadcast(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(bounds)], "_s int, _a double, _b double"))
        held = dict(rows.join(small, F.col("time").between(F.col("_a"), F.col("_b"))).groupBy("_s").count().collect())
        sizes = np.array([held.get(k, 0) for k in range(len(bounds))])
        last = np.cumsum(sizes)
        tail += _table_bytes("AIPS NX", [("TIME", "1D", bounds.mean(1) / 24), ("TIME INTERVAL", "1D", (bounds[:, 1] - bounds[:, 0]) / 24), ("SOURCE ID", "1J", np.ones(len(bounds))), ("SUBARRAY", "1J", np.ones(len(bounds))), ("START VIS", "1J", last - sizes + 1), ("END VIS", "1J", last)], [])
    rf, day = seen.rf, JD + mjd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written = f"{path}.part", 0
        with open(part, "wb") as out:
            out.write(start)
            for batch in batches:
                x = {c: batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k, c in enumerate(batch.schema.names)}
                n = batch.num_rows
                group = np.zeros((n, 9 + 12), ">f4")
                for k, values in enumerate((x["u"] / rf, x["v"] / rf, 0.0, 256 * x["_n1"] + x["_n2"], day, x["time"] / 24, x["tint"], x["tau1"], x["tau2"])):
                    group[:, k] = values
                for k in range(4):
                    re_, im, sigma = (x[c] for c in parts[3 * k : 3 * k + 3])
                    with np.errstate(all="ignore"):
                        weight = 1 / sigma**2
                    good = np.isfinite(re_) & np.isfinite(im) & np.isfinite(weight)
                    for j, values in enumerate((re_, im, weight)):
                        group[:, 9 + 3 * k + j] = np.where(good, values, 0.0)
                out.write(group.tobytes())
                written += group.nbytes
            out.write(b"\0" * (-written % BLOCK))
            out.write(tail)
        os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([written])], ["written"])

    rows.orderBy("time", "_n1", "_n2").coalesce(1).mapInArrow(run, StructType([StructField("written", LongType())])).collect()


IMAGE = StructType([StructField("path", StringType()), StructField("nx", IntegerType()), StructField("ny", IntegerType()), StructField("psize", DoubleType()), StructField("ra", DoubleType()), StructField("dec", DoubleType()), StructField("rf", DoubleType()), StructField("mjd", DoubleType()), *(StructField(f"{s}pix", ArrayType(DoubleType())) for s in "iquv")])


def _image(path: str, content: bytes) -> dict:
    import io

    data = io.BytesIO(content)
    found = [u for u in units(data) if u.header.get("NAXIS", 0) >= 2 and "TFIELDS" not in u.header]
    h = found[0].header
    row = {"path": path, "nx": h["NAXIS1"], "ny": h["NAXIS2"], "psize": abs(float(h.get("CDELT1", 1.0))) * DEGREE, "ra": float(h.get("OBSRA", h.get("CRVAL1", 0.0))) * 12 / 180, "dec": float(h.get("OBSDEC", h.get("CRVAL2", 0.0))), "rf": float(h.get("FREQ", h.get("CRVAL3", 0.0))), "mjd": float(h.get("MJD", 0.0))}
    row |= {f"{s}pix": None for s in "iquv"}
    for k, unit in enumerate(found):
        stokes = str(unit.header.get("STOKES", unit.header.get("EXTNAME", "I" if k == 0 else ""))).strip().lower()
        if stokes in ("i", "q", "u", "v"):
            data.seek(unit.start)
            n = h["NAXIS1"] * h["NAXIS2"]
            kind = np.dtype(NUMBERS[unit.header["BITPIX"]])
            values = np.frombuffer(data.read(n * kind.itemsize), kind).astype(float) * float(unit.header.get("BSCALE", 1.0)) + float(unit.header.get("BZERO", 0.0))
            row[f"{stokes}pix"] = values.reshape(h["NAXIS2"], h["NAXIS1"])[::-1].ravel().tolist()
    return row


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """FITS images, one row a file: the arrays go row by row from the top (north), missing products are NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                row = _image(one, content.as_py())
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("nx", pa.int32()), ("ny", pa.int32()), *((c, pa.float64()) for c in ("psize", "ra", "dec", "rf", "mjd")), *((f"{s}pix", pa.list_(pa.float64())) for s in "iquv")]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGE)


def image_bytes(nx: int, ny: int, psize: float, planes: dict[str, np.ndarray], ra: float = 0.0, dec: float = 0.0, rf: float = 0.0, mjd: float = 0.0, source: str = "") -> bytes:
    """A FITS file of one image; ``planes`` holds i and, if there are any, q, u and v."""
    out = b""
    for k, (stokes, values) in enumerate(planes.items()):
        cards: list[tuple[str, object]] = [("SIMPLE", True) if k == 0 else ("XTENSION", "IMAGE"), ("BITPIX", -64), ("NAXIS", 2), ("NAXIS1", nx), ("NAXIS2", ny)]
        cards += [("PCOUNT", 0), ("GCOUNT", 1), ("EXTNAME", stokes.upper())] if k else [("EXTEND", True)]
        cards += [("OBJECT", source), ("CTYPE1", "RA---SIN"), ("CTYPE2", "DEC--SIN"), ("CDELT1", -psize / DEGREE), ("CDELT2", psize / DEGREE), ("OBSRA", ra * 15.0), ("OBSDEC", dec), ("FREQ", rf), ("CRPIX1", nx / 2 + 0.5), ("CRPIX2", ny / 2 + 0.5), ("MJD", mjd), ("BUNIT", "JY/PIXEL"), ("STOKES", stokes.upper())]
        out += _header(cards) + _padded(np.asarray(values, float).reshape(ny, nx)[::-1].astype(">f8").tobytes())
    return out


def write_images(images: DataFrame, folder: str) -> None:
    """One FITS file ``<image_id>.fits`` a row of (image_id, nx, ny, psize, ipix and, if any, qpix, upix, vpix), written by tasks."""
    extra = [s for s in "quv" if f"{s}pix" in images.columns]
    fields = ["image_id", "nx", "ny", "psize", "ipix", *(f"{s}pix" for s in extra)]

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            planes = {s: r[f"{s}pix"] for s in ("i", *extra) if r[f"{s}pix"] is not None}
            part = os.path.join(folder, f"{r['image_id']}.fits.part")
            with open(part, "wb") as out:
                out.write(image_bytes(r["nx"], r["ny"], r["psize"], planes))
            os.replace(part, part[:-5])

    images.select(*fields).foreachPartition(run)
