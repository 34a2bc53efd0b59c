"""Flow of movies: brightness that is carried along by a field of motions, one field a movie.

Frames are rows (movie_id, frame, pix), frame counted without gaps; a field has a motion for each pixel, ``down`` along the rows' number and
``right`` along the columns', in pixels a frame. A frame is followed by I - m . grad I - I div m; derivatives are central differences that
go around the edges. For a given movie the field is a linear least-squares problem of which nine sums a pixel hold all, however long the
movie; for a given field each frame is a small problem that asks for its two neighbours only, so odd and even frames are solved in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.minimise import lbfgs
from ..sources.ranges import shared_folder
from .imaging import Sums, frame_sum_rows

#: The sums of a pixel: products of the slopes down (r) and right (c), brightness (s) and change to the next frame (d).
SUMS = ("rr", "rc", "cc", "rs", "cs", "ss", "rd", "cd", "sd")


def _down(x: np.ndarray) -> np.ndarray:
    return (np.roll(x, -1, -2) - np.roll(x, 1, -2)) / 2


def _right(x: np.ndarray) -> np.ndarray:
    return (np.roll(x, -1, -1) - np.roll(x, 1, -1)) / 2


def carry(x: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The frame that the field makes of ``x``."""
    return x - down * _down(x) - right * _right(x) - x * (_down(down) + _right(right))


def carry_back(r: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The adjoint of ``carry``."""
    return r + _down(down * r) + _right(right * r) - r * (_down(down) + _right(right))


def _pairs(frames: DataFrame) -> DataFrame:
    """Frames with ``after``, the next frame of their movie; the last have none."""
    later = frames.select("movie_id", (F.col("frame") - 1).alias("frame"), F.col("pix").alias("after"))
    return frames.select("movie_id", "frame", "pix").join(later, ["movie_id", "frame"])


def _at(name: str, k: Column) -> Column:
    return F.get(name, k.cast("int")).cast("double")


def _slopes(name: str, n: int, i: Column) -> tuple[Column, Column]:
    row, col = F.floor(i / n), F.pmod(i, F.lit(n))
    at = lambda r, c: _at(name, F.pmod(r, F.lit(n)) * n + F.pmod(c, F.lit(n)))
    return (at(row + 1, col) - at(row - 1, col)) / 2, (at(row, col + 1) - at(row, col - 1)) / 2


def flow_sums(frames: DataFrame, n: int) -> DataFrame:
    """(movie_id, i, rr ... sd): of each pixel, the sums over a movie's consecutive frames that its field follows from.

    Added up before they are shuffled. Pairs in which a pixel or a neighbour is NULL are left out of that pixel's sums.
    """

    def one(i: Column) -> Column:
        r, c = _slopes("pix", n, i)
        return F.struct(i.cast("int").alias("i"), r.alias("r"), c.alias("c"), _at("pix", i).alias("s"), (_at("after", i) - _at("pix", i)).alias("d"))

    pixels = _pairs(frames).select("movie_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), one)).alias("p")).select("movie_id", "p.*").dropna()
    return pixels.groupBy("movie_id", "i").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in SUMS])


def flow_term(frames: DataFrame, fields: DataFrame, n: int) -> DataFrame:
    """(movie_id, value): squared differences of frames from what the field (movie_id, down, right) makes of those before, over the number of frames."""

    def miss(i: Column) -> Column:
        r, c = _slopes("pix", n, i)
        div = _slopes("down", n, i)[0] + _slopes("right", n, i)[1]
        d = _at("after", i) - _at("pix", i) + _at("down", i) * r + _at("right", i) * c + _at("pix", i) * div
        return d * d

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), miss), F.lit(0.0), lambda s, x: s + x)
    sums = _pairs(frames).join(fields, "movie_id").groupBy("movie_id").agg(F.sum(total).alias("_s"))
    counts = frames.join(fields.select("movie_id"), "movie_id").groupBy("movie_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(sums, "movie_id", "left").select("movie_id", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("value"))


def solved_field(sums: dict[str, np.ndarray], smoothness: float, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(down, right) of the least squared change left over, plus ``smoothness`` times the squared slopes of the field, by conjugate gradients.

    A pixel's change is r * down + c * right + s * (slope of down + slope of right); slopes are antisymmetric, so their adjoint is their negative.
    """
    g = sums

    def normal(m: np.ndarray) -> np.ndarray:
        a, b = m
        div = _down(a) + _right(b)
        by_s = g["rs"] * a + g["cs"] * b + g["ss"] * div
        out = np.array([g["rr"] * a + g["rc"] * b + g["rs"] * div - _down(by_s), g["rc"] * a + g["cc"] * b + g["cs"] * div - _right(by_s)])
        return out - smoothness * (_down(_down(m)) + _right(_right(m)))

    right = -np.array([g["rd"] - _down(g["sd"]), g["cd"] - _right(g["sd"])])
    m = np.zeros_like(right)
    left = right.copy()
    way, size = left.copy(), float((left * left).sum())
    least = 1e-24 * size
    for _ in range(steps):
        if size <= least:
            break
        turned = normal(way)
        length = size / max(float((way * turned).sum()), 1e-300)
        m, left = m + length * way, left - length * turned
        new = float((left * left).sum())
        way, size = left + new / size * way, new
    return m[0], m[1]


def movie_fields(frames: DataFrame, n: int, smoothness: float) -> DataFrame:
    """(movie_id, down, right): the field of each movie; a movie of one frame, or of no change, has none but zeros.

    A movie's sums are n * n rows, which one task solves; movies are dealt over tasks.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grids = {c: np.zeros(n * n) for c in SUMS}
        for c in SUMS:
            grids[c][rows["i"].to_numpy()] = rows[c].to_numpy()
        a, b = solved_field({c: x.reshape(n, n) for c, x in grids.items()}, smoothness)
        return pd.DataFrame({"movie_id": rows["movie_id"].iloc[:1].to_numpy(), "down": [a.ravel().tolist()], "right": [b.ravel().tolist()]})

    kind = frames.schema["movie_id"].dataType.simpleString()
    found = flow_sums(frames, n).groupBy("movie_id").applyInPandas(run, f"movie_id {kind}, down array<double>, right array<double>")
    still = F.array_repeat(F.lit(0.0), n * n)
    return frames.select("movie_id").distinct().join(found, "movie_id", "left").select("movie_id", F.coalesce("down", still).alias("down"), F.coalesce("right", still).alias("right"))


def frame_misfit(x: np.ndarray, sums: Sums | None, before: np.ndarray | None, after: np.ndarray | None, field: tuple[np.ndarray, np.ndarray], weight: float) -> tuple[float, np.ndarray]:
    """A frame's chi-square and ``weight`` times its squared differences from both neighbours' flow; with the gradient."""
    value, slope = sums.chisq(x) if sums is not None else (0.0, np.zeros_like(x))
    if before is not None:
        d = x - carry(before, *field)
        value, slope = value + weight * (d * d).sum(), slope + 2 * weight * d
    if after is not None:
        d = carry(x, *field) - after
        value, slope = value + weight * (d * d).sum(), slope + 2 * weight * carry_back(d, *field)
    return float(value), slope


def make_flow_movie(vis: DataFrame, n: int, pixel: float, frame: str, start: np.ndarray, steadiness: float, smoothness: float, rounds: int = 6, steps: int = 40) -> tuple[DataFrame, DataFrame]:
    """(frames, field) of positive images of a movie's visibilities and the flow between them, each solved in turn.

    ``frame`` is a column of whole numbers without gaps; rows with nulls take no part, and frames without any visibility
    between the first and the last follow from their neighbours. ``start`` is the positive image that all frames begin with;
    ``steadiness`` weighs departures from the flow (over the squared flux of ``start``), ``smoothness`` the field's slopes
    (times the movie's mean squared brightness and length). Frames stay in tables; the driver sees none of them. Every round writes its tables to the shared folder.
    """
    spark, flux = vis.sparkSession, float(start.sum())
    weight = steadiness / flux**2
    folder, count = shared_folder(spark), iter(range(1 << 30))

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    seen = frame_sum_rows(vis, n, pixel, frame)
    data = kept(seen.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("data")))
    ends = data.agg(F.min("frame").alias("a"), F.max("frame").alias("b")).first()
    schema = "movie_id long, frame long, pix array<double>"
    if ends["a"] is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "movie_id long, down array<double>, right array<double>")
    length, m = ends["b"] - ends["a"] + 1, n * n
    first = F.array(*[F.lit(float(x)) for x in start.ravel()])
    frames = kept(spark.range(ends["a"], ends["b"] + 1).select(F.lit(0).cast("long").alias("movie_id"), F.col("id").alias("frame"), first.alias("pix")))
    field = kept(movie_fields(frames, n, 1.0))

    def solved(parity: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, at in enumerate(batch["frame"].to_pylist()):
                    row = lambda c: batch[c][k].values.to_numpy() if batch[c][k].is_valid else None  # noqa: B023, E731
                    raster = lambda c: None if row(c) is None else row(c).reshape(n, n)  # noqa: B023, E731
                    pix = row("pix")
                    if at % 2 == parity:
                        got = row("data")
                        sums = None if got is None else Sums(got[:m].reshape(n, n), got[m:-3].reshape(2 * n - 1, 2 * n - 1), float(got[-3]), float(got[-2]), int(got[-1]), pixel)
                        args = (sums, raster("before"), raster("after"), (raster("down"), raster("right")), weight)

                        def f(z: np.ndarray, args: tuple = args) -> tuple[float, np.ndarray]:
                            x = np.exp(np.clip(z, -80, 80)).reshape(n, n)
                            value, slope = frame_misfit(x, *args)
                            return value, (slope * x).ravel()

                        pix = np.exp(np.clip(lbfgs(f, np.log(np.maximum(pix, 1e-30)), steps), -80, 80))
                    out.append(pix)
                yield pa.RecordBatch.from_arrays([batch["movie_id"], batch["frame"], pa.array(out, pa.list_(pa.float64()))], ["movie_id", "frame", "pix"])

        return run

    bright = flux**2 / m * length
    for _ in range(rounds):
        for parity in (0, 1):
            side = lambda by, name: frames.select((F.col("frame") + by).alias("frame"), F.col("pix").alias(name))  # noqa: B023, E731
            whole = frames.join(data, "frame", "left").join(side(1, "before"), "frame", "left").join(side(-1, "after"), "frame", "left")
            # The field is one row of the image's size.
            frames = kept(whole.join(F.broadcast(field), "movie_id").mapInArrow(solved(parity), schema))
        field = kept(movie_fields(frames, n, smoothness * bright / m))
    return frames, field
