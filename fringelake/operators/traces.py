"""Closure traces: what is left of polarised visibilities when any Jones matrices of the stations are taken out.

V of a baseline is [[rr, rl], [lr, ll]]; corruptions make it J1 V J2'. Round a quadrangle
the trace of V12 V32^-1 V34 V14^-1, halved, holds none of them: neither gains nor leakages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from .closure import _quadrangles
from .jones import HANDS, _product

NAMES = tuple(f"{h}vis_{x}" for h in HANDS for x in ("re", "im"))


def _matrix(leg: str) -> list[cx.Pair]:
    return [(F.col(f"{leg}.{h}vis_re"), F.col(f"{leg}.{h}vis_im")) for h in HANDS]


def _turned(m: list[cx.Pair], keep: Column) -> list[cx.Pair]:
    """The matrix, or its conjugate transpose where not ``keep``."""
    other = [cx.conj(m[0]), cx.conj(m[2]), cx.conj(m[1]), cx.conj(m[3])]
    return [(F.when(keep, a[0]).otherwise(b[0]), F.when(keep, a[1]).otherwise(b[1])) for a, b in zip(m, other, strict=True)]


def _inverse(m: list[cx.Pair]) -> list[cx.Pair]:
    det = cx.sub(cx.mul(m[0], m[3]), cx.mul(m[1], m[2]))
    return [cx.div(z, det) for z in (m[3], cx.scale(m[1], -1.0), cx.scale(m[2], -1.0), m[0])]


def closure_traces(circ: DataFrame, count: str = "max") -> DataFrame:
    """(time, t1..t4, trace_re, trace_im) of the quadrangles of each time; NULL where a matrix has no inverse or a product is null.

    A time's rows are brought together once, as for closure amplitudes; baselines may come in either order, once each.
    """
    key = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    entry = F.struct(key(F.col("t1"), F.col("t2")), F.struct(F.col("t1").alias("from"), *NAMES))
    times = circ.groupBy("time").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("t1", "t2"))))).alias("s"), F.map_from_entries(F.collect_list(entry)).alias("legs"))
    rows = times.select("time", "legs", F.explode(_quadrangles(count)).alias("q")).select("time", "q.*", "legs")
    pairs = {"p12": ("t1", "t2"), "p32": ("t3", "t2"), "p34": ("t3", "t4"), "p14": ("t1", "t4")}
    rows = rows.withColumns({p: F.try_element_at("legs", key(F.col(a), F.col(b))) for p, (a, b) in pairs.items()}).drop("legs").filter(" and ".join(f"{p} is not null" for p in pairs))

    def named(name: str, m: list[cx.Pair]) -> dict[str, Column]:
        return {f"{name}{k}_{x}": c for k, z in enumerate(m) for c, x in zip(z, ("re", "im"), strict=True)}

    cells = lambda name: [cx.pair(f"{name}{k}") for k in range(4)]
    legs = {p: _turned(_matrix(p), F.col(f"{p}.from") == F.col(a)) for p, (a, _) in pairs.items()}
    rows = rows.withColumns({c: x for p, m in legs.items() for c, x in named(f"m_{p}", m).items()})
    halves = {"one": ("m_p12", "m_p32"), "two": ("m_p34", "m_p14")}
    rows = rows.withColumns({c: x for name, (a, b) in halves.items() for c, x in named(name, _product(cells(a), _inverse(cells(b)))).items()})
    a, b = cells("one"), cells("two")
    total = cx.add(cx.add(cx.mul(a[0], b[0]), cx.mul(a[1], b[2])), cx.add(cx.mul(a[2], b[1]), cx.mul(a[3], b[3])))
    half = cx.scale(total, 0.5)
    # A generator, which conditions on the trace are not carried through: they would repeat all the products within themselves.
    made = F.explode(F.array(F.struct(half[0].alias("trace_re"), half[1].alias("trace_im"))))
    return rows.select("time", "t1", "t2", "t3", "t4", made.alias("z")).select("time", "t1", "t2", "t3", "t4", "z.*")
