"""Top-k search against brute force, on tables where blocks can be pruned and where none can."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fringelake.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score long, row string"


def brute(rows, every=50, k=5):
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(q):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(q) if b != a)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every=50, **options):
    table = spark.createDataFrame([(i, v, 0, 9, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % every == 0, **options).select("query_id", "rank", "vec_id", "score").collect()))


def noise(rng, n, width=8):
    return [rng.uniform(-1, 1) for _ in range(width)]


def cases():
    rng = random.Random(2)
    plain = [(i, noise(rng, 8)) for i in range(300)]
    yield "plain", [*plain, (300, None), (301, [math.nan] * 8), (302, [None] + [1.0] * 7), (350, []), (None, plain[0][1])]
    yield "four", [(i, [float(i), 1.0]) for i in range(4)]
    yield "one", [(0, [1.0, 2.0])]
    yield "no query", [(i, noise(rng, 8)) for i in range(1, 40)]
    yield "repeated ids", [(0, noise(rng, 8)) for _ in range(4)] + [(7, plain[1][1])] * 3 + [(50, plain[1][1])] * 2
    yield "ties", [(i, [1.0, -1.0]) for i in range(200)]
    yield "lengths", [(i, noise(rng, 8, 1 + i % 5)) for i in range(120)]
    yield "large", [(i, [rng.uniform(-1, 1) * 1e6 for _ in range(4)]) for i in range(60)]


@pytest.mark.parametrize("name, rows", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_against_brute_force(spark, name, rows):
    want = brute(rows)
    assert run(spark, rows, block_rows=32, query_rows=4) == want and (want or name in ("one", "no query"))


def test_components_beyond_64_bits_are_held(spark):
    got = run(spark, [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0])])
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_far_blocks_are_not_met(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        v = [rng.gauss(0, 0.02) for _ in range(16)]
        v[(i // 2) % 16] += 3.0 if i % 2 else -3.0
        rows.append((i, v))
    stats = []
    assert run(spark, rows, block_rows=32, query_rows=16, growth=2, stats=stats) == brute(rows)
    assert len(stats) > 2 and sum(stats[:-1]) < 0.2 * stats[-1]
