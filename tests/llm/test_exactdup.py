"""Exact duplicates against a plain grouping, with hot groups, ties, nulls and repeated rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fringelake.llm import exactdup

SCHEMA = "doc_id long, text string, digest string, rid long, n long, best string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        ordered = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, best, len(ids), k == 0, digest) for k, i in enumerate(ordered)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def corpus():
    rng = random.Random(1)
    rows = [(i, "HOT Copy" if i % 3 == 0 else f"text {rng.randrange(400)}") for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "ÀÉ stay É"), (2004, "ÀÉ STAY É"), (2005, "àé stay é"), (2006, "İstanbul K"), (2007, "word " * 30000), (2008, "WORD " * 30000)]
    rows += [(None, "hot copy"), (None, "only nulls"), (None, "ONLY nulls"), (2010, "same row"), (2010, "same row"), (2010, "same row"), (5, "hot cOPY"), (1497, "hot copy"), (-3, "negative"), (-9, "Negative")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", [1, 3, 16, exactdup.COUNTERS])
def test_against_plain_grouping(spark, counters):
    rows = corpus()
    assert got(exactdup.mark_duplicates(table(spark, rows), counters)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)], [(7, "a")] * 50], ids=["empty", "null text", "nulls", "one row often"])
def test_small_tables(spark, rows):
    assert got(exactdup.mark_duplicates(table(spark, rows))) == brute(rows)


def test_every_frequent_digest_is_found_and_they_are_few(spark):
    rng = random.Random(4)
    texts = [f"f{i}" for i in range(6) for _ in range(300)] + [f"s{i}" for i in range(4000)]
    rng.shuffle(texts)
    rows = exactdup.digests(table(spark, list(enumerate(texts))).repartition(7, "doc_id"))
    found = {bytes(r["digest"]): (r["n"], r["best"]["doc_id"]) for r in exactdup.frequent_digests(rows, 20).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert found == {hashlib.sha256(f"f{i}".encode()).digest(): (300, last[f"f{i}"]) for i in range(6)}


def test_frequent_rows_are_not_shuffled_and_no_python_runs(spark):
    marked = exactdup.mark_duplicates(table(spark, [(i, "a" if i % 2 else f"b{i}") for i in range(400)]), 16)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("hashpartitioning") == 1
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
    assert marked.filter("kept").count() == marked.agg(F.countDistinct("text_sha256")).first()[0] == 201
