"""Closure traces: against matrices, and unchanged by any Jones matrices."""

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import jones, traces


def circ(spark, stations="ABCDE", times=3, seed=1):
    rng = np.random.default_rng(seed)
    rows, out = [], {}
    for t in range(times):
        for i, a in enumerate(stations):
            for b in stations[i + 1 :]:
                m = rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))
                x, y = (a, b) if rng.uniform() > 0.3 else (b, a)
                out[t, x, y], out[t, y, x] = m, m.conj().T
                rows.append((float(t), x, y, *[float(v) for z in (m[0, 0], m[0, 1], m[1, 0], m[1, 1]) for v in (z.real, z.imag)]))
    return spark.createDataFrame(rows, "time double, t1 string, t2 string, " + ", ".join(f"{n} double" for n in traces.NAMES)), out


def test_traces_against_matrices(spark):
    table, m = circ(spark)
    for count, number in (("max", 15), ("min", 5)):
        rows = traces.closure_traces(table, count).collect()
        assert len(rows) == 3 * number
        for r in rows:
            t, a, b, c, d = int(r["time"]), *(r[f"t{k}"] for k in range(1, 5))
            want = np.trace(m[t, a, b] @ np.linalg.inv(m[t, c, b]) @ m[t, c, d] @ np.linalg.inv(m[t, a, d])) / 2
            assert np.isclose(complex(r["trace_re"], r["trace_im"]), want)


def test_corruptions_leave_no_trace(spark):
    table, _ = circ(spark)
    rng = np.random.default_rng(2)
    rows = [(s, float(t), *map(float, rng.normal(size=8))) for s in "ABCDE" for t in range(3)]
    matrices = spark.createDataFrame(rows, "site string, time double, " + ", ".join(f"{c}_{x} double" for c in jones.CELLS for x in ("re", "im")))
    key = lambda r: tuple(r[:5])
    before = {key(r): complex(r["trace_re"], r["trace_im"]) for r in traces.closure_traces(table).collect()}
    after = {key(r): complex(r["trace_re"], r["trace_im"]) for r in traces.closure_traces(jones.apply(table, matrices)).collect()}
    assert before.keys() == after.keys() and all(np.isclose(before[k], after[k]) for k in before)


def test_holes(spark):
    table, _ = circ(spark, "ABCD", 1)
    assert traces.closure_traces(table.filter("not (t1 in ('A', 'B') and t2 in ('A', 'B'))")).count() == 1
    null = table.withColumn("rlvis_re", F.lit(None).cast("double"))
    assert traces.closure_traces(null).filter("trace_re is not null").count() == 0
    assert traces.closure_traces(table.filter("time < 0")).count() == 0
