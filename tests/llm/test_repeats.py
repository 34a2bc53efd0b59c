"""Substring dedup against brute force: borders, overlaps, wide anchors, many equal rows."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from fringelake.llm import repeats

SCHEMA = "doc_id long, text string, key long, spans string, copied int"


def brute(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {x for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for x in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return sorted(map(tuple, repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def pieces(rng, passages, n):
    """Texts that share parts of passages, cut anywhere, with edits."""
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            part = list(p[a : a + rng.randrange(10, 90)])
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "x"
            words += part
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("wide", [64, 1], ids=["pairs", "wide anchors"])
def test_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = random.Random(8)
    passages = [[f"p{k}_{i}" for i in range(120)] for k in range(3)] + [["a", "b", "c"] * 40, ["same"] * 120]
    texts = [None, "", " \t ", "one", " ".join(["same"] * 35), " ".join(["same"] * 36), " ".join(f"long{i % 700}" for i in range(20000)), *pieces(rng, passages, 150)]
    rows = [*enumerate(texts), (None, texts[9]), (3, texts[10]), (3, texts[10])]
    want = brute(rows)
    assert run(spark, rows) == want and len({x[2] for x in want}) > 10


def test_match_of_a_window_and_one_word_less(spark):
    shared = [f"s{i}" for i in range(36)]
    for n in (34, 35, 36):
        rows = [(0, "a b " + " ".join(shared[:n]) + " c"), (1, "d " + " ".join(shared[:n]))]
        assert [x[2] for x in run(spark, rows)] == ([0, 0] if n == 34 else [n, n]) and run(spark, rows) == brute(rows)


def test_extension_both_ways():
    words = np.arange(62, dtype=np.uint64)
    other = words.copy()
    other[20], other[58] = 1000, 1001  # differ 7 before the anchor and 23 after it
    who, before, after = repeats.extend(np.array([5, 5, 6]), np.array([27, 27, 27]), [words, other, words], 35, 8)
    assert (who.tolist(), before.tolist(), after.tolist()) == ([0, 1], [6, 6], [23, 23])
    third = words.copy()
    third[40] = 1002
    who, before, after = repeats.extend(np.array([5] * 3), np.array([27] * 3), [words, other, third], 35, 8)
    assert list(zip(who.tolist(), before.tolist(), after.tolist())) == [(0, 27, 5), (0, 6, 23), (1, 6, 23), (2, 27, 5)]


def test_many_equal_rows_take_linear_time(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(200))
    run(spark, [(None, text)] * 2)
    spent = []
    for n in (500, 5000):
        start = time.time()
        got = run(spark, [(None, text)] * n)
        spent.append(time.time() - start)
        assert len(got) == n and {x[2] for x in got} == {200}
    assert spent[1] < 10 * spent[0]


def test_text_is_kept_with_its_columns(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = spark.createDataFrame([(0, f"keep  this {shared}", 1, "x", 2), (1, f"{shared} and this", 1, "y", 3), (2, "two  blanks", 1, "z", 4)], SCHEMA)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, keep_text=True).collect()}
    assert [got[i]["text"] for i in range(3)] == ["keep this", "and this", "two  blanks"] and [got[i]["spans"] for i in range(3)] == ["x", "y", "z"]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_common_passage_is_not_told_window_by_window(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(45))
    own = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(i, f"{own(rng.randrange(40))} {passage} {own(rng.randrange(40))}") for i in range(300)]
    docs, made = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA), spark.sparkContext.accumulator(0)
    real = type(docs).mapInArrow

    def counted(self, function, schema, *more, **named):
        def run(batches):
            for batch in function(batches):
                made.add(len(batch) if "content" in batch.schema.names else 0)
                yield batch

        return real(self, run, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    assert run(spark, rows) == brute(rows)
    # Up to 28 windows for each of some 600 reaches otherwise.
    assert 0 < made.value < 8 * len(rows)


def test_wide_anchors_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WIDE", 1)
    rng = random.Random(9)
    rows = list(enumerate(pieces(rng, [[f"p{k}_{i}" for i in range(90)] for k in range(3)], 60)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
