"""Rows and intervals of time, and curves through knots.

An interval is listed once for each block of hours that it meets, and a row is in one
block, so that a join by range becomes a join by equality with a condition: no
nested loop, and pairs are found once. Where at most one interval is wanted (the one
that began last), intervals and rows are one time-ordered union within key and
block, so that nothing is compared with all of a block's intervals either.

Curves are segments, a row each; a cubic spline is solved in pieces that overlap by
``HALO`` knots: what a knot does to another's slope falls by half or more a knot, so that
pieces give the whole curve's numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a block.
BLOCK = 1.0
#: Knots of a piece of a spline, and those that it shares with each neighbour.
PIECE, HALO = 4096, 64


def _block(time: Column, hours: float) -> Column:
    return F.floor(time / hours)


def with_blocks(spans: DataFrame, start: Column, stop: Column, hours: float = BLOCK) -> DataFrame:
    """Each interval once for every block that it meets, as ``_block``; none if its end comes before its start or is null."""
    return spans.filter(start <= stop).withColumn("_block", F.explode(F.sequence(_block(start, hours), _block(stop, hours))))


def join_spans(rows: DataFrame, spans: DataFrame, start: Column, stop: Column, condition: Column, how: str = "inner", hours: float = BLOCK) -> DataFrame:
    """Rows with the intervals for which ``condition`` holds; ``start`` and ``stop`` must bound the times that meet it."""
    listed = with_blocks(spans, start, stop, hours)
    out = rows.withColumn("_block", _block(F.col("time"), hours)).join(listed.withColumnRenamed("_block", "_spans"), (F.col("_block") == F.col("_spans")) & condition, how)
    return out.drop("_block", "_spans")


def last_begun(rows: DataFrame, spans: DataFrame, key: str, start: str, stop: str, name: str, hours: float = BLOCK) -> DataFrame:
    """``name`` for every row: of the spans of its ``key``, a struct of the one that began last at or before its time, if that span reaches its block.

    The rows' key column must be called ``key`` too. Keys are divided by blocks, so that a station with most rows is many groups.
    """
    other = [c for c in spans.columns if c != key]
    listed = with_blocks(spans, F.col(start), F.col(stop), hours).select(key, "_block", F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*other).alias("_span"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row"))
    own = rows.select(key, _block(F.col("time"), hours).alias("_block"), F.col("time").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(listed.schema["_span"].dataType).alias("_span"), F.struct(*rows.columns).alias("_row"))
    w = Window.partitionBy(key, "_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return listed.unionByName(own).withColumn("_span", F.last("_span", True).over(w)).filter("_kind = 1").select("_row.*", F.col("_span").alias(name))


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline whose first two and last two pieces are one polynomial each; y may have columns."""
    n, h = len(x), np.diff(x)
    y = np.asarray(y, float).reshape(n, -1)
    if n < 3:
        return np.zeros_like(y)
    d = np.diff(y, axis=0) / h[:, None]
    if n == 3:  # a parabola
        return np.repeat(2 * (d[1:] - d[:1]) / (x[2] - x[0]), 3, axis=0)
    # Rows of the inner knots, with the outer ones written by their neighbours.
    low, mid, up, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d, axis=0)
    mid[0] += h[0] * (1 + h[0] / h[1])
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        k = low[i] / mid[i - 1]
        mid[i] -= k * up[i - 1]
        right[i] -= k * right[i - 1]
    m = np.zeros_like(y)
    m[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (right[i] - up[i] * m[i + 2]) / mid[i]
    m[0] = m[1] + h[0] / h[1] * (m[1] - m[2])
    m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    return m


def _with_slopes(knots: DataFrame, key: str, parts: tuple[str, ...], piece: int) -> DataFrame:
    """Knots with second derivatives d_<part>."""
    numbered = knots.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("time")) - 1)
    home = F.floor(F.col("_i") / piece)
    low, high = F.greatest(F.floor((F.col("_i") - HALO) / piece), F.lit(0)), F.floor((F.col("_i") + HALO) / piece)
    listed = numbered.withColumn("_piece", F.explode(F.sequence(low, high))).withColumn("_own", home == F.col("_piece"))
    columns = [key, "time", *parts]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            y = np.column_stack([t[c].to_numpy() for c in parts])
            m = spline_slopes(t["time"].to_numpy(), y)
            for c, column in zip(parts, m.T, strict=True):
                t = t.append_column(f"d_{c}", pa.array(column))
            yield from t.filter(t["_own"]).select([*columns, *[f"d_{c}" for c in parts]]).to_batches()

        now = None
        for b in batches:
            keys = list(zip(b[key].to_pylist(), b["_piece"].to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            for i, j in zip(edges, edges[1:], strict=False):
                if keys[i] != now and held:
                    yield from out()
                    held = []
                now = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    kinds = dict(knots.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"d_{c} double" for c in parts])
    ordered = listed.select(*columns, "_piece", "_own").repartition(key, "_piece").sortWithinPartitions(key, "_piece", "time")
    return ordered.mapInArrow(solve, schema)


def segments(knots: DataFrame, key: str, parts: tuple[str, ...], method: str = "linear", piece: int = PIECE) -> DataFrame:
    """key, lo, hi, a_<part>, b_<part> (and for "cubic" da_<part>, db_<part>): the pieces of each key's curve, of knots with a time each.

    The last knot is a segment of its own, without ``hi``. Knots with a null time or part are left out; of equal times one stays.
    """
    knots = knots.select(key, F.col("time").cast("double").alias("time"), *[F.col(c).cast("double").alias(c) for c in parts]).dropna(subset=["time", *parts]).dropDuplicates([key, "time"])
    if method == "cubic":
        knots = _with_slopes(knots, key, parts, piece)
    w = Window.partitionBy(key).orderBy("time")
    more = [("a_", "b_", c) for c in parts] + ([("da_", "db_", f"d_{c}") for c in parts] if method == "cubic" else [])
    strip = lambda c: c.removeprefix("d_") if c.startswith("d_") else c
    return knots.select(key, F.col("time").alias("lo"), F.lead("time").over(w).alias("hi"), *[x.alias(p + strip(c)) for a, b, c in more for p, x in ((a, F.col(c)), (b, F.lead(c).over(w)))])


def _value(span: Column, time: Column, part: str, method: str) -> Column:
    """A segment's polynomial, whether ``time`` is within it or not."""
    h = span["hi"] - span["lo"]
    s, a, b = (time - span["lo"]) / h, span[f"a_{part}"], span[f"b_{part}"]
    if method == "nearest":
        return F.when(s > 0.5, b).otherwise(a)
    if method == "linear":
        return a + s * (b - a)
    if method != "cubic":
        raise ValueError(method)
    r = 1 - s
    return a * r + b * s + h * h / 6 * ((r * r * r - r) * span[f"da_{part}"] + (s * s * s - s) * span[f"db_{part}"])


def at_curve(rows: DataFrame, knots: DataFrame, key: str, parts: tuple[str, ...], method: str = "linear", extrapolate: bool = False, absent: dict[str, float] | None = None, outside: dict[str, float] | None = None, hours: float = BLOCK) -> DataFrame:
    """Add each part of the curve of a row's ``key`` at its ``time``, under the parts' names.

    Keys without a curve have the values of ``absent`` (else NULL), a curve of one knot that knot's at all times. Outside a longer curve
    come the values of ``outside`` (else NULL), or its end pieces go on (``extrapolate``). "nearest" takes the earlier of equals.
    """
    pieces = segments(knots, key, parts, method)
    names = [c for c in pieces.columns if c != key]
    ends = pieces.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*names), "lo").alias("first"), F.max_by(F.struct(*names), F.when(F.col("hi").isNotNull(), F.col("lo"))).alias("last"), F.max_by(F.struct(*names), "lo").alias("end"))
    out = last_begun(rows, pieces.filter("hi is not null"), key, "lo", "hi", "_span", hours)
    # A row a key: as many as there are stations.
    out = out.join(ends.select(key, F.struct("n", "first", "last", "end").alias("_ends")), key, "left")
    span, time, first, last, end = F.col("_span"), F.col("time"), F.col("_ends.first"), F.col("_ends.last"), F.col("_ends.end")
    values = {}
    for part in parts:
        beyond = F.lit((outside or {}).get(part)).cast("double")
        before, after = (_value(first, time, part, method), _value(last, time, part, method)) if extrapolate else (beyond, beyond)
        value = F.when(F.col("_ends.n") == 1, end[f"a_{part}"]).when(time < first["lo"], before).when(time == end["lo"], end[f"a_{part}"]).when(time > end["lo"], after)
        value = value.when(time == span["lo"], span[f"a_{part}"]).otherwise(_value(span, time, part, method))
        values[part] = F.when(F.col("_ends").isNull(), F.lit((absent or {}).get(part)).cast("double")).otherwise(value)
    return out.withColumns(values).drop("_span", "_ends")
