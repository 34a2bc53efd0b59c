"""Agreement sets against plain pairs and a plain search for cliques."""

import itertools

import numpy as np
import pytest

from fringelake.operators import agreements


@pytest.mark.parametrize("blocks", [None, 1, 4])
def test_pairs(spark, blocks):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 9))
    rows = [(i, (base[i % 6] + 0.3 * rng.normal(size=9)).tolist()) for i in range(60)]
    odd = [(100, None), (101, [1.0] * 9), (102, [None] + [1.0] * 8), (103, [float("nan")] + [1.0] * 8), (None, rows[0][1]), (104, []), (105, rows[0][1][:5]), (7, rows[7][1])]
    got = sorted((r["a"], r["b"], round(r["value"], 9)) for r in agreements.pairs(spark.createDataFrame(rows + odd, "image_id int, pix array<double>"), 0.8, blocks).collect())
    want = []
    usable = rows + [(7, rows[7][1])]
    for (i, x), (j, y) in itertools.combinations(usable, 2):
        if i != j and np.corrcoef(x, y)[0, 1] >= 0.8:
            want.append((min(i, j), max(i, j), round(float(np.corrcoef(x, y)[0, 1]), 9)))
    assert got == sorted(want) and len(want) > 50


def test_blocks_of_any_number_are_stored_once(spark, monkeypatch):
    """What is written does not grow with the number of blocks, and no block grows with the table."""
    monkeypatch.setattr(agreements, "BLOCK", 8)
    kept = []

    def keep(frame):
        kept.append(store(frame))
        return kept[-1]

    store = agreements.stored
    monkeypatch.setattr(agreements, "stored", keep)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    found = agreements.pairs(spark.createDataFrame(rows, "image_id int, pix array<double>"), 0.9, 3)
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if np.corrcoef(x, y)[0, 1] >= 0.9}
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    sizes = [len(r["ids"]) // 8 for r in kept[0].collect()]
    assert sum(sizes) == 200 and max(sizes) <= agreements.BLOCK
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def plain(links):
    nodes = sorted({x for e in links for x in e})
    near = {x: {b if a == x else a for a, b in links if x in (a, b)} for x in nodes}
    out = []

    def grow(r, p, x):
        if not p and not x:
            out.append(sorted(r))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(nodes), set())
    return sorted(out)


@pytest.mark.parametrize("n, share, seed", [(12, 0.3, 1), (18, 0.6, 2), (25, 0.15, 3), (9, 1.0, 4)])
def test_cliques(spark, n, share, seed):
    rng = np.random.default_rng(seed)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.uniform() < share]
    table = spark.createDataFrame([*links, links[0], links[0][::-1], (3, 3)], "a long, b long")
    assert sorted(r["members"] for r in agreements.cliques(table).collect()) == plain(links)


def dense(n, share, seed):
    rng = np.random.default_rng(seed)
    return [(i * 7 - 50, j * 7 - 50) for i in range(n) for j in range(i + 1, n) if rng.uniform() < share]


@pytest.mark.parametrize("cells", [8, 300, 1 << 22])
def test_cliques_in_rounds(spark, monkeypatch, cells):
    """Blocks, rounds and tables of any size give the same sets, and all rounds are read back."""
    for name, value in (("NODES", 4), ("ENTRIES", 24), ("CELLS", cells), ("ROUND", 1200)):
        monkeypatch.setattr(agreements, name, value)
    hub = [(-1000, 7 * i - 50) for i in range(30)] + [(-1000, 2000 + i) for i in range(20)]
    links = dense(30, 0.4, 5) + hub
    kept, store = [], agreements.stored
    monkeypatch.setattr(agreements, "stored", lambda frame: kept.append(store(frame)) or kept[-1])
    found = agreements.cliques(spark.createDataFrame([*links, *links[:9]], "a long, b long"))
    got = sorted(r["members"] for r in found.collect())
    assert got == plain(links) and sum(x.columns == ["members"] for x in kept) > 2


def test_a_path_of_two_links_is_no_row(spark):
    """A set of n images sends a row for each link and node, where it sent one for each path of two links."""
    n = 40
    links = spark.createDataFrame(dense(n, 1.0, 1), "a long, b long")
    found = agreements.cliques(links)
    assert [len(r["members"]) for r in found.collect()] == [n]

    def rows(node):
        """Most rows that a node of a plan made."""
        made = node.metrics().get("numOutputRows")
        below = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else [node.children().apply(i) for i in range(node.children().size())]
        return max([made.get().value() if made.isDefined() else 0, *map(rows, below)])

    assert rows(found._jdf.queryExecution().executedPlan()) <= n * (n - 1) // 2 + n


def test_blocks_are_not_joined_by_their_size(spark):
    """All images have one size, so that a join by it would meet all blocks in one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(3)
        found = agreements.pairs(spark.createDataFrame([(i, rng.normal(size=4 + i % 2).tolist()) for i in range(40)], "image_id int, pix array<double>"), 0.5, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_links(spark):
    assert agreements.cliques(spark.createDataFrame([], "a long, b long")).count() == 0
    assert agreements.pairs(spark.createDataFrame([], "image_id int, pix array<double>"), 0.5).count() == 0
