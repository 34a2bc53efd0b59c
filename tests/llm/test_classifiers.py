"""The two classifiers: their parts against plain computations, and held-out accuracy on texts whose class is known."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from fringelake.llm import charfeat, langid, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, label string, predicted string"
LABELS = "doc_id long, quality int, toxic int, text string"


def fold(i, divisor):
    return zlib.crc32(str(i).encode()) % divisor


def grams(text, sizes, letters=False):
    out = set()
    for word in text.lower().split():
        word = f" {''.join(c for c in word if c.isalpha()) if letters else word} "
        out |= {word[i : i + n] for n in sizes for i in range(len(word) - n + 1)}
    return out


def test_presence_of_ngrams():
    texts = ["Ab abba", "", None, "a1b ÄÖ", "x " * 3000 + "yz", "straße"]
    for sizes, letters in ((range(3, 7), False), (range(1, 5), True)):
        found = list(charfeat.presence(pa.array(texts), sizes, 18, letters))
        number = {}
        for text, own in zip(texts, found):
            want = grams(text or "", sizes, letters)
            assert sorted(set(own.tolist())) == own.tolist() and len(own) <= len(want) and (len(want) == 0) == (len(own) == 0)
            for g in want:  # the number of an n-gram is that of the text which has no other
                alone = set(own.tolist()) if len(want) == 1 else None
                number.setdefault(g, set(own.tolist()))
                number[g] &= set(own.tolist())
                assert number[g] and (alone is None or number[g] == alone)


def toxic_corpus(n=900):
    rng = random.Random(5)
    mild, harsh = [f"mild{k}" for k in range(300)], ["scumbagge", "vermintalk", "hatewordy"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        words = rng.choices(mild, k=rng.randrange(5, 60)) + (rng.choices(harsh, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", 1.0, "x", "y"))
        labels.append((i, 0, toxic, "z"))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = toxic_corpus()
    long_clean, long_toxic = " ".join(["mild1"] * 20000), " ".join(["mild1"] * 20000 + ["scumbagge vermintalk hatewordy"])
    rows += [(10_000, None, None, 1.0, "x", "y"), (10_001, "", None, 1.0, "x", "y"), (10_002, long_clean, "en", 1.0, "x", "y"), (10_003, long_toxic, "en", 1.0, "x", "y")]
    rows += [rows[0]] * 50 + [(None, "mild2", "en", 1.0, "x", "y")]
    got = toxicity.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1, ""), (5, 0, None, "")], LABELS)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, _, toxic, _ in labels:
        assert by[i]["held_out"] == (fold(i, 4) == 2) and by[i]["predicted"] == int(by[i]["score"] >= 0.3) == toxic
    assert [by[i]["predicted"] for i in (10_000, 10_001, 10_002, 10_003, None)] == [0, 0, 0, 1, 0]


def test_ratios_and_choice_of_ngrams():
    rng = np.random.default_rng(2)
    labels = np.array([1] * 60 + [0] * 240)
    rows = [np.unique(np.concatenate([rng.integers(10, 40, 12), [3] if y and rng.random() < 0.9 or rng.random() < 0.02 else []])).astype(np.int64) for y in labels]
    p, q = (np.bincount(np.concatenate([x for x, y in zip(rows, labels) if y == k]), minlength=64).astype(float) for k in (1, 0))

    def g(j):
        table = [[p[j], 60 - p[j]], [q[j], 240 - q[j]]]
        total = 0.0
        for a in range(2):
            for b in range(2):
                expected = sum(table[a]) * (table[0][b] + table[1][b]) / 300
                total += 2 * table[a][b] * math.log(table[a][b] / expected) if table[a][b] else 0
        return total

    assert toxicity.choose(p, q, 60, 240).tolist() == [j for j in range(64) if p[j] + q[j] and g(j) >= toxicity.G_LEAST]
    weights, intercept = toxicity.fit(rows, labels, p, q)
    ratio = math.log((p[3] + 0.5) / 61) - math.log((q[3] + 0.5) / 241)
    # One scaled feature: the optimum of the penalised likelihood, by its gradient.
    has = np.array([3 in x for x in rows])
    z = weights[3] * has + intercept
    error = 1 / (1 + np.exp(-z)) - labels
    assert np.count_nonzero(weights) == 1 and abs(error.sum()) < 1e-2 and abs((error * has).sum() * ratio + weights[3] / ratio) < 1e-2


def test_copies_leave_the_fit_but_unlike_texts_stay():
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:70] + other[:130]), " ".join(words)]
    rows = [{"label": int(i == 3), "sketch": s} for i, s in enumerate(toxicity.sketches(pa.array(texts)))]
    assert toxicity.without_copies(rows) == [rows[0], rows[2], rows[3]]


def test_rows_of_one_id_count_once_in_the_sample(spark):
    rows, labels = toxic_corpus(240)
    learned = next(i for i, _, toxic, _ in labels if not toxic and fold(i, 4) != 2)
    copies = [(learned, f"scumbagge vermintalk hatewordy {k}", "en", 1.0, "x", "y") for k in range(400)]
    got = toxicity.classify(spark.createDataFrame(rows + copies, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    toxic = {i for i, _, t, _ in labels if t}
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in toxic)


def languages(rng, n):
    letters = {"aa": "abcde ", "bb": "cdefg ", "cc": "ghijk ", "dd": "äöüßé "}
    return [(i, "".join(rng.choices(letters[k], k=rng.randrange(30, 200))) + letters[k][0] * 2, k) for i in range(n) for k in [("aa", "bb", "cc", "dd")[min(3, int(rng.expovariate(0.9)))]]]


def test_language_of_held_out_texts(spark):
    own = languages(random.Random(1), 500)
    rows = [(i, t, k, 1.0, "x", "y") for i, t, k in own]
    rows += [(900, None, "aa", 1.0, "x", "y"), (901, "", "aa", 1.0, "x", "y"), (902, "12 34 !?", "bb", 1.0, "x", "y"), (903, "abab" * 20000, None, 1.0, "x", "y"), (None, "gh ij kk", None, 1.0, "x", "y"), rows[0], rows[0]]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (fold(i, 5) == 0) for i, _, _ in own) and all(0 <= r["score"] <= 1 for r in got)
    apart = [(by[i]["lang_pred"], k) for i, _, k in own if by[i]["held_out"]]
    assert sum(a == b for a, b in apart) >= 0.97 * len(apart)
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3 and by[903]["lang_pred"] == "aa" and by[None]["lang_pred"] == "cc"


def test_nystrom_ridge_is_that_of_the_kernel():
    """With every row a landmark, the folded weights give exact kernel ridge regression."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(100 * (i % 3), 100 * (i % 3) + 150, 40)).astype(np.int32) for i in range(30)]
    langs = [f"l{i % 3}" for i in range(30)]
    names, weights = langid.fit(rows, langs, landmarks=30)
    unit = langid.matrix(rows).astype(float)
    kernel = unit @ unit.T
    share = 1 / 10
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    want = kernel @ np.linalg.solve(kernel + langid.RIDGE / share * np.eye(30), target)
    got = langid.sparse_product(rows, weights) / np.sqrt([len(x) for x in rows])[:, None]
    assert names == ["l0", "l1", "l2"] and np.abs(got - want).max() < 1e-3


def test_sparse_product(monkeypatch):
    monkeypatch.setattr(langid, "ENTRIES", 7)
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 3, 9, 0, 1, 20, 0)]
    table = rng.normal(size=(50, 3)).astype(np.float32)
    dense = np.zeros((7, 50))
    for i, x in enumerate(rows):
        dense[i, x] = 1
    assert np.allclose(langid.sparse_product(rows, table), dense @ table)


def test_more_languages_than_landmarks(spark):
    rng = random.Random(9)
    names = [f"l{k:03}" for k in range(600)]
    rows = [(i, " ".join([f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}"] * rng.randrange(1, 4)), names[k], 1.0, "x", "y") for i, k in enumerate(list(range(600)) * 3)]
    learned = {r[2] for r in rows if fold(r[0], 5)}
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    lang = {r[0]: r[2] for r in rows}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if lang[r["doc_id"]] in learned]
    assert len(learned) > 590 and sum(right) > 0.97 * len(right)
