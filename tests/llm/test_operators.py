"""The text operators against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fringelake.llm import decontaminate, jaccard, langid, mixing, pitmanyor, queries, repeats, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"


def words(rng, n, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = [None, "", "  \t\n", "one", "one two three", "one two three", words(rng, 20000)]
    for i in range(30):
        texts.append(words(rng, rng.randrange(1, 120)) + (" " + passage + " " if i % 3 == 0 else " ") + words(rng, rng.randrange(0, 60)))
    base = words(rng, 300).split()
    for _ in range(8):
        near = list(base)
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = "x"
        texts.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, 0, 1.0, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).cache()


def split(text):
    return (text or "").encode().split()


def test_jaccard(docs, corpus):
    sets = {}
    for i, text, *_ in corpus:
        w = split((text or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_prefix_tree_joins_all_queries():
    import numpy as np

    rng = np.random.default_rng(1)
    first = rng.integers(0, 500, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 500, 60), first)).astype(np.uint64) for _ in range(60)]
    got = {(m, int(i)) for m, found in jaccard.PrefixTree(sets).joined(sets[::-1], 85) for i in found}
    assert got == {(m, i) for m, s in enumerate(sets) for i, q in enumerate(sets[::-1]) if 100 * len(np.intersect1d(s, q)) >= 85 * len(np.union1d(s, q))}


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 4)
    rng = random.Random(3)
    start = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for i in range(40):
        own = list(start)
        for k in rng.sample(range(80), rng.randrange(5)):
            own[k] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(own), "en", "s", 0, 0.0, ""))
    sets = {r[0]: {tuple(r[1].split()[k : k + 4]) for k in range(77)} for r in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert len(set(comp.values())) > 1
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == comp


def test_jaccard_hot_shingles(docs, monkeypatch):
    want = sorted(map(tuple, jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(jaccard, "HOT", -1)
    monkeypatch.setattr(jaccard, "HOT_MEANS", 0)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_sketch_counts_are_packed():
    import numpy as np

    for most in (0, 255, 256, 65535, 65536, 2**31 - 1):
        counts = np.array([0, 1, most, 0], np.int64)
        assert jaccard._counts(jaccard._packed(counts), 4).tolist() == counts.tolist()


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    target = {r["source"]: r["target"] for r in rows}
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_flight_keeps_the_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    size = rng.integers(0, 900, 200).astype(float)
    out = mixing.flight(size, np.full(200, 0.3), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - 60) < 1e-6 and abs(out @ size - 0.3 * size.sum()) < 1e-3


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
def test_tokens_match_the_public_tokenizer(docs, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokens.read_vocabulary()
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    want = [len(x.ids) for x in t.encode_batch([r[1] or "" for r in corpus], add_special_tokens=False)]
    assert [r["n_tokens"] for r in tokens.count_tokens(docs, vocabulary).orderBy("doc_id").collect()] == want


def test_toxicity_and_language_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, none).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert said[0] == said[1] == "und" and said[3] == "en"


def test_toxicity_sample_keeps_the_ratio_of_the_classes(spark):
    import math

    rng = random.Random(6)
    # Texts say nothing about their label, so that the score is the share of toxic ones, sampled or not.
    rows = [(i, words(rng, 12), "en", "s", 0, 0.0, "") for i in range(1200)]
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    _, whole = toxicity.train(docs, labels)
    _, sampled = toxicity.train(docs, labels, sample_per_class=60)
    assert abs(1 / (1 + math.exp(-whole)) - 0.1) < 0.03 and abs(1 / (1 + math.exp(-sampled)) - 0.1) < 0.03


def test_every_language_has_a_landmark():
    import numpy as np

    for sizes in ((126, 66, 96, 95), (300, 300, 300, 1), (3, 1, 1), (1,) * 400):
        langs = [f"l{k:03}" for k, n in enumerate(sizes) for _ in range(n)]
        assert {langs[i] for i in langid.landmark_places(langs, 192)} == set(langs)
    # The last language has n-grams of its own, and so weights.
    langs = ["a"] * 300 + ["b"] * 300 + ["c"] * 300 + ["d"] * 50
    rows = [np.array([10 * ord(x), 10 * ord(x) + 1 + i % 5], np.int32) for i, x in enumerate(langs)]
    names, weights = langid.fit(rows, langs)
    assert [names[int(np.argmax(weights[x].sum(axis=0)))] for x in rows] == langs and abs(weights[10 * ord("d")]).max() > 0


def test_revisits(spark):
    rows = [(1, "http://a.org/x", 1, "response", "e1", None, {"a": "1", "date": "0"}, "body"), (2, "HTTP://www.A.org/x/", 2, "revisit", "e1", None, {"Date": "9", "a": "2"}, None), (3, "http://a.org/x", 3, "revisit", "e2", None, None, None), (4, "http://b.org/", 1, "revisit", "e", None, None, None), (5, None, None, "revisit", None, None, None, None)]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.CAPTURE)).collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["response", "resolved", "mismatch", "unresolved", "unresolved"]
    assert got[2]["resolved_id"] == 1 and got[2]["merged_headers"] == {"a": "1", "Date": "9"}
    record = warc.format_record("response", "http://a.org/", "2020-01-01T00:00:00Z", "<x>", "HTTP/1.1 200 OK", {"ETag": "t"}, "hé")
    assert [r["headers"]["warc-type"] for r in warc.parse_records(record * 2)] == ["response"] * 2


def test_revisits_have_bodies(spark):
    h, rows = {"a": "1"}, []
    for i in range(3):  # three responses share an id, three have none, and a revisit follows each
        for rid, host in ((7, "a"), (None, "b")):
            rows.append((rid, f"http://{host}{i}.org/", 1, "response", f"e{i}", None, h, f"body {host}{i}"))
            rows.append((rid, f"http://{host}{i}.org/", 2, "revisit", f"e{i}", None, None, None))
    rows += [(8, "http://c.org/", 1, "response", "e", None, h, "twice")] * 2
    rows += [(9, "http://c.org/", 2, "revisit", "other", None, None, "not its own"), (10, "http://d.org/", 1, "response", "e", None, h, None), (11, "http://d.org/", 2, "revisit", "e", None, None, None)]
    captures = spark.createDataFrame(rows, warc.CAPTURE)
    got = Counter((r["canonical_url"], r["ts"], r["status"], r["body"]) for r in warc.with_bodies(warc.resolve_revisits(captures), captures).collect())
    want = Counter()
    for host in "ab":
        for i in range(3):
            want[f"http://{host}{i}.org", 1, "response", f"body {host}{i}"] += 1
            want[f"http://{host}{i}.org", 2, "resolved", f"body {host}{i}"] += 1
    want["http://c.org", 1, "response", "twice"] = 2
    want["http://c.org", 2, "mismatch", None] = want["http://d.org", 1, "response", None] = want["http://d.org", 2, "resolved", None] = 1
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no synthetic tables")
def test_query_of_revisits_returns_bodies(spark):
    sf = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op9_bodies"](spark, sf).collect()
    assert len(rows) == 2 * len(html) and any(r["status"] == "resolved" for r in rows)
    for r in rows:
        body = html[(r["record_id"] if r["kind"] == "response" else r["resolved_id"]) // 2] if r["status"] in ("response", "resolved") else None
        assert (r["body_bytes"], r["body_sha256"]) == ((None, None) if body is None else (len(body.encode()), hashlib.sha256(body.encode()).hexdigest()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert tokens.count_tokens(none, [("<unk>", 0.0), ("a", -1.0)]).count() == 0
    assert langid.identify(none).count() == 0
    assert pitmanyor.score_all(none).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 50 == 0).count() == 0
    some = spark.createDataFrame([(1, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, some).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.resolve_revisits(spark.createDataFrame([], warc.CAPTURE)).count() == 0
