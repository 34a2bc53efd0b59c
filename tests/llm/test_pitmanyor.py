"""The language model: counts and base scores against brute force, probabilities that add up, and exact seating."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fringelake.llm import pitmanyor

SCHEMA = "doc_id long, text string, lang string, score double, block string"


def apart(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def split(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1.0, "x") for i, t in rows], SCHEMA)


def texts(rng):
    out = [None, "", " \t\n", "one", "One ONE two", "ÄÖ äö", " ".join(f"w{rng.randrange(3000)}" for _ in range(30000))]
    out += [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(200))) for _ in range(120)]
    return [*enumerate(out), (None, "one two"), (None, "one two"), (5, "one")]


@pytest.mark.parametrize("options", [{}, {"bucket_tokens": 900, "block_bytes": 4000}], ids=["plain", "many buckets and hot words"])
def test_counts_and_base_scores(spark, options):
    rows = texts(random.Random(3))
    counts = Counter()
    for i, text in rows:
        if not apart(i):
            counts.update([*split(text), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        t = [*split(text), "\n"]
        want.append((i, apart(i), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)))
    got = pitmanyor.score_all(frame(spark, rows), by_token=True, **options).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["score"] < 0 and len(r["token_scores"]) == r["n_tokens"] and abs(sum(r["token_scores"]) - r["score"]) < 1e-6


@pytest.mark.parametrize("bucket_tokens", [pitmanyor.BUCKET_TOKENS, 60], ids=["one bucket", "many buckets and hot words"])
def test_probabilities_add_up(spark, bucket_tokens):
    rng = random.Random(4)
    learn = [i for i in range(4000) if not apart(i)]
    rows = [(learn[k], " ".join(rng.choice("abcdefgh") + "x" * rng.randrange(3) for _ in range(12))) for k in range(120)]
    vocabulary = sorted({x for _, t in rows for x in t.split()}) + ["neverseen"]
    ids = iter(i for i in range(10**6) if apart(i))
    asked = {}
    for first in ["a", "bx", "neverseen"]:  # the end token is that of the text without a second word
        for second in [*vocabulary, None]:
            asked[next(ids)] = (first, second)
    docs = frame(spark, rows + [(i, " ".join(x for x in pair if x)) for i, pair in asked.items()])
    got = {r["doc_id"]: 10 ** np.array(r["token_scores"]) for r in pitmanyor.score_all(docs, by_token=True, bucket_tokens=bucket_tokens, block_bytes=900).collect()}
    for word in ["a", "bx", "neverseen"]:
        assert abs(sum(got[i][1] for i, (first, _) in asked.items() if first == word) - 1) < 1e-9
    starts = {}
    for i, (first, second) in asked.items():
        starts[first] = got[i][0]
    assert all(p > 0 for p in starts.values())


def test_contexts_matter(spark):
    rng = random.Random(4)
    lines = [" ".join(x for _ in range(10) for k in [rng.randrange(40)] for x in (f"former{k}", f"latter{k}")) for _ in range(400)]
    got = pitmanyor.score_all(frame(spark, list(enumerate(lines)))).collect()
    score = [r["score"] / r["n_tokens"] for r in got if r["held_out"]]
    # Ten of 21 tokens are free among 40 words (0.76 a token); without contexts all are among 80 (1.8).
    assert -1.0 < sum(score) / len(score) < -0.76
    by = {r["held_out"]: r for r in pitmanyor.perplexity(pitmanyor.score_all(frame(spark, list(enumerate(lines))))).collect()}
    assert by[True]["perplexity"] < 10 < by[True]["base_perplexity"]


def one_by_one(n, parent, others, d, rng):
    """Gibbs sampling customer by customer of one dish: the mean number of tables."""
    tables, total, kept = [n], 0, 0
    for sweep in range(3000):
        for _ in range(n):
            who = rng.randrange(n)
            for k, size in enumerate(tables):
                if who < size:
                    break
                who -= size
            tables[k] -= 1
            if not tables[k]:
                tables.pop(k)
            weights = [x - d for x in tables] + [(1 + d * (others + len(tables))) * parent]
            k = rng.choices(range(len(weights)), weights)[0]
            if k < len(tables):
                tables[k] += 1
            else:
                tables.append(1)
        if sweep >= 200:
            total, kept = total + len(tables), kept + 1
    return total / kept


@pytest.mark.parametrize("n, parent, others, d", [(2, 0.3, 5, 0.7), (6, 0.05, 40, 0.6), (20, 0.2, 3, 0.4)])
def test_tables_as_customer_by_customer(n, parent, others, d):
    want = one_by_one(n, parent, others, d, random.Random(1))
    for exact, tolerance in ((64, 0.03), (1, 0.06)):  # from the exact distribution, and seated with acceptance
        rng = np.random.default_rng(2)
        got = pitmanyor.draw(np.full(6000, n), np.full(6000, parent), np.full(6000, float(others)), d, rng, exact=exact).mean()
        assert abs(got - want) < tolerance * want, (exact, got, want)


def test_chunks_as_one_by_one():
    n, parent, others, d = 20_000.0, 0.01, 50.0, 0.7
    arguments = (np.full(300, n), np.full(300, (1 + d * (others + 1)) * parent), np.full(300, d * parent), d)
    chunks = pitmanyor.seat(*arguments, np.random.default_rng(1))[0].mean()
    single = pitmanyor.seat(*arguments, np.random.default_rng(2), singly=10**9)[0].mean()
    assert abs(chunks - single) < 0.04 * single


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 70000, 2**40]), np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64, endpoint=False)), np.zeros(0, np.uint64)):
        (y,) = pitmanyor.unpack(pitmanyor.pack(x))
        assert y.tolist() == x.tolist() and len(pitmanyor.unpack(pitmanyor.pack(x, x))) == 2


def test_without_training_rows(spark):
    ids = [i for i in range(100) if apart(i)][:3]
    got = pitmanyor.score_all(frame(spark, [(i, "a b") for i in ids])).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 3
    assert pitmanyor.score_all(frame(spark, [])).count() == 0


def test_many_equal_rows(spark):
    got = pitmanyor.score_all(frame(spark, [(None, "a b c d")] * 3000 + [(1, "a b")]), block_bytes=2000).collect()
    assert len(got) == 3001 and len({r["score"] for r in got}) == 2
