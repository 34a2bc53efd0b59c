"""Spelling variants against a plain version: every pair of words compared."""

import os
import random
import re
import zlib
from collections import Counter

import pytest

from fringelake.llm import queries, variants

SCHEMA = "doc_id long, text string, word string, n long, form string, part string"
LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    """All pairs: by shared deletions, each compared."""
    at = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for group in at.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    return near


def brute(rows):
    words = plain_words(rows)
    near = neighbours(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)
    return sorted(map(tuple, variants.group_variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def corpus():
    rng = random.Random(11)
    base = ["letters", "Keeping", "señalar", "größer", "coûteux", "abcdefghijklmnop", "zzzzzz", "aaaaaaa", "banana"]
    words = Counter()
    for w in base:
        words[w] = 2000 if w == "Keeping" else 300
        for level, n in ((1, 60), (2, 11), (3, 6)):
            for _ in range(12):
                v = w
                for _ in range(level):
                    i, kind = rng.randrange(len(v)), rng.randrange(3)
                    v = v[:i] + ("" if kind == 0 else rng.choice("aeéz")) + v[i + (kind != 1) :]
                words[v] = max(words[v], n - rng.randrange(2))
    for i in range(400):  # many words of one prefix and one suffix
        words["commonprefix" + "".join(rng.choice("ab") for _ in range(6))] = 5 + i % 9
        words["".join(rng.choice("ab") for _ in range(6)) + "commonsuffix"] = 5 + i % 30
    flat = [w.upper() if w.isascii() and rng.random() < 0.1 else w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    rows = [(i, rng.choice((" ", "\n", ", ", "4", " Ł")).join(flat[i * 200 : (i + 1) * 200])) for i in range(len(flat) // 200 + 1)]
    return [*rows, (None, "letters " * 9), (None, None), (-4, ""), (9000, "!? 123 — ×÷"), (9001, "lettres " * 30000), (9002, "x" * 5000 + " " + "x" * 5001 + " y"), *[(9003, "x" * 5000 + " " + "x" * 5001)] * 5]


@pytest.mark.parametrize("most_nodes", [variants.MOST_NODES, 300, 0])
def test_against_all_pairs(spark, most_nodes):
    rows = corpus()
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 50 and sum(w[1] != w[2] and w[1] is not None for w in want) > 5
    assert run(spark, rows, most_nodes=most_nodes) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short few words")], [(i, "letters") for i in range(6)]], ids=["empty", "null", "short", "one word"])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_trie_join_finds_all_ordered_pairs():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(300)})
    got = list(variants.near_pairs(words))
    assert len(got) == len(set(got)) and sorted(got) == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b))


def test_a_prefix_with_most_words_is_divided(spark):
    rng = random.Random(8)
    words = {"sharedprefix" + "".join(rng.choice("abcd") for _ in range(8)) for _ in range(3000)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long").cache()
    sizes = [r["count"] for r in variants.partitions(table, 400).groupBy("part").count().collect()]
    assert max(sizes) < 200  # of 3,000 words that share all of their first half


def test_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 10)
    assert [w for p in variants._runs("Letters ÀÀÀàààà, x1 keepingKEEPING…señales") for w in p] == ["letters", "ÀÀÀàààà", "keepingkeeping", "señales"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no synthetic tables")
def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute(rows)
