"""Decontamination against a full exact search: near copies, low variety, short texts."""

import random
from collections import Counter

import numpy as np
import pytest

from fringelake.llm import decontaminate

SCHEMA = "doc_id long, text string, key long, item_id long, similarity string"


def grams(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(docs, items):
    """(doc_id, item_id, similarity, first word) of the best window, the first of equals."""
    out = []
    for d, text in docs:
        w = (text or "").lower().split()
        for j, item in items:
            own = (item or "").lower().split()
            want = grams(own)
            if not want or len(w) < min(5, len(own)):
                continue
            best = (0.0, 0)
            for s in range(max(1, len(w) - len(own) + 1)):
                here = Counter(tuple(w[i : i + min(5, len(own))]) for i in range(s, min(len(w), s + len(own)) - min(5, len(own)) + 1))
                sim = sum((here & want).values()) / sum((here | want).values())
                if sim > best[0]:
                    best = (sim, s)
            if best[0] >= 0.8:
                out.append((d, j, round(best[0], 9), best[1]))
    return sorted(out, key=str)


def run(spark, docs, items):
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in decontaminate.find_leaks(table, bench).collect()), key=str)


def edited(rng, words, most):
    out = list(words)
    for _ in range(rng.randrange(most + 1)):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, "x"), lambda: out.insert(k, "y"), lambda: out.pop(k)])()
        if not out:
            break
    return out


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    items = [(j, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 40, 90])))) for j in range(24)]
    items += [(90, None), (91, ""), (92, items[3][1]), (93, "a b a b a b a b a b a b"), (94, " ".join(["same"] * 30 + [f"v{i}" for i in range(30)])), (None, items[6][1])]
    docs = [(0, None), (1, ""), (2, " \n"), (3, items[4][1]), (3, items[4][1]), (None, items[5][1].upper())]
    for i in range(120):
        _, item = rng.choice(items)
        own = edited(rng, (item or "z").split(), 3)
        docs.append((10 + i, " ".join([word() for _ in range(rng.randrange(25))] + own + [word() for _ in range(rng.randrange(25))])))
    docs.append((9, " ".join(word() for _ in range(20000)) + " " + items[7][1]))
    return docs, items


@pytest.mark.parametrize("seed, vocabulary", [(1, 5000), (2, 6), (3, 2)])
def test_against_full_search(spark, seed, vocabulary):
    docs, items = corpus(seed, vocabulary)
    if vocabulary < 100:
        docs = docs[:-1]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 40


def test_recall_of_the_radius():
    """Pairs of similarity 0.8 to 0.9, with even and uneven counts: all but 1 in 1,000 at most are within the radius."""
    rng = np.random.default_rng(7)
    missed = total = 0
    for common, repeated, other in ((4, 4, 1), (10, 10, 1), (8, 0, 1), (16, 0, 2), (80, 10, 1), (40, 0, 5), (36, 0, 4), (160, 0, 20)):
        for _ in range(300):
            own = rng.integers(0, 2**63, common, dtype=np.uint64)
            again = np.repeat(rng.integers(0, 2**63, 1, dtype=np.uint64), repeated)
            a = np.concatenate([own, again, rng.integers(0, 2**63, other, dtype=np.uint64)])
            b = np.concatenate([own, again, rng.integers(0, 2**63, other, dtype=np.uint64)])
            if decontaminate.weighted_jaccard(a, b) < 0.8:
                continue
            x, y = (decontaminate.fingerprints(s, np.zeros(1, np.int64), len(s)) for s in (a, b))
            total += 1
            missed += not len(decontaminate.MultiIndex(y).within(x)[0])
    assert total > 2000 and missed <= total / 1000


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**64, (300, 4), dtype=np.uint64, endpoint=False)
    prints = items[rng.integers(0, 300, 200)].copy()
    for i in range(200):
        for bit in rng.choice(256, rng.integers(40, 90), replace=False):
            prints[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    want = {(i, j) for i in range(200) for j in range(300) if np.bitwise_count(prints[i] ^ items[j]).sum() <= 63}
    at, item = decontaminate.MultiIndex(items).within(prints)
    assert set(zip(at.tolist(), item.tolist())) == want and len(at) == len(want) and 40 < len(want) < 200


def test_fingerprint_of_windows_is_that_of_their_own_text():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 9, 60).astype(np.uint64)
    starts = np.arange(40)
    whole = decontaminate.fingerprints(g, starts, 20)
    for s in starts:
        assert (whole[s] == decontaminate.signs(decontaminate.element_bits(decontaminate.elements(g[s : s + 20], decontaminate.occurrences(g[s : s + 20]))).sum(axis=0, dtype=np.int32)[None])[0]).all()


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == [] and run(spark, [(1, "a b")], []) == []
