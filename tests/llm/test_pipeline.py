"""The corpus pipeline: every stage against a plain version of its decision, on its own input, and the whole."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from fringelake.llm import toxicity
from fringelake.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARSH = "scumbagge vermintalk hatewordy"


def shingles(text, n=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    some = lambda n: [word() for _ in range(n)]
    passage, item = some(60), some(40)
    texts = [None, "", " \t", "one two", "one two", " ".join(some(20000))]
    for i in range(160):
        w = some(rng.randrange(30, 120))
        if i % 8 == 0:
            w = w[:10] + passage + w[10:]
        if i % 11 == 0:
            w = w[:5] + item + w[5:]
        if i % 5 == 0:
            w += HARSH.split()
            rng.shuffle(w)
        texts.append(" ".join(w))
    base = some(200)
    for k in range(6):
        near = list(base)
        near[k * 7] = "x"
        texts.append(" ".join(near))
    texts += [texts[7]] * 4
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)] + [(20, texts[20], "en", "a", len(texts[20]))] * 2 + [(None, "null id " + " ".join(some(20)), "en", "b", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(HARSH.split()[0] in (t or ""))) for i, t, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(frame):
    return Counter(map(tuple, frame.select(*corpus_pipeline.COLUMNS).collect()))


def test_toxic_documents_go(spark, folder):
    docs = table(spark, folder, "documents")
    kept = stage("toxicity")(spark, docs, folder)
    said = toxicity.classify(docs, table(spark, folder, "labels")).filter("predicted = 1").select("doc_id").collect()
    gone = {r["doc_id"] for r in said}
    have = rows(docs)
    assert rows(kept) == Counter({r: n for r, n in have.items() if r[0] not in gone}) and all(HARSH.split()[0] in (r[1] or "") for r in have if r[0] in gone) and len(gone) > 25


def test_one_of_each_group_of_near_copies_stays(spark, folder):
    docs = table(spark, folder, "documents")
    have = list(rows(docs).elements())
    sets = [shingles(r[1]) for r in have]
    group = list(range(len(have)))
    for a in range(len(have)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    stays = {}
    for r, g, s in zip(have, group, sets):
        if s and (g not in stays or (r[0] is None, r[0]) < (stays[g][0] is None, stays[g][0])):
            stays[g] = r
    want = Counter(list(stays.values()) + [r for r, s in zip(have, sets) if not s])
    assert rows(stage("ngram_jaccard_join")(spark, docs, folder)) == want and sum(want.values()) < len(have) - 8


def test_repeated_passages_go(spark, folder):
    docs = table(spark, folder, "documents")
    have = list(rows(docs).elements())
    seen = Counter(tuple(w[k : k + 35]) for r in have for w in [(r[1] or "").split()] for k in range(len(w) - 34))
    want = Counter()
    for r in have:
        w = (r[1] or "").split()
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
        want[(r[0], text, r[2], r[3], len(text) if gone else r[4])] += 1
    assert rows(stage("substring_dedup")(spark, docs, folder)) == want


def test_documents_with_a_benchmark_item_go(spark, folder):
    docs = table(spark, folder, "documents")
    item = " ".join((spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first()["text"]).split())
    have = rows(docs)
    want = Counter({r: n for r, n in have.items() if item not in (r[1] or "")})
    got = rows(stage("benchmark_decontamination")(spark, docs, folder))
    gone = have - got
    # Shuffled texts hold the item in pieces only; whatever else went must hold most of it.
    assert not got - want and all(len(shingles(r[1]) & shingles(item)) > 25 for r in gone) and sum(gone.values()) > 8


def test_mixture_of_all_documents(spark, folder):
    docs = table(spark, folder, "documents")
    got = stage("mixing")(spark, docs, folder).collect()
    have = list(rows(docs).elements())
    size = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in have)
    weight, total = {"a": 3.0, "b": 1.0, None: 2.0}, Counter()
    for r in have:
        total[r[3]] += size(r[1])
    level, capped = 0.0, set()
    while True:
        free = [s for s in total if s not in capped]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > 2 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * total[s] if s in capped else weight[s] * level for s in total}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] and r["source_size"] == total[r["source"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(size(r[1]) for r in have if r[3] == s) for s in total}  # one source has a text of 20,000 words
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in total)


def test_whole_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = table(spark, folder, "documents")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(name)(spark, docs, folder).collect(), DOCS)
    want = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in stage("mixing")(spark, docs, folder).collect())
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == want and 60 < len(got) < 160


def test_empty_and_clashing_input(spark, folder):
    none = spark.createDataFrame([], DOCS + ", score double, predicted int, n_words long, key long, spans string, comp string")
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, none, folder).count() == 0
    some = table(spark, folder, "documents").selectExpr("*", "1.0 score", "'x' predicted", "'y' n_words", "'z' `key`", "1 spans", "2 comp", "3 taken")
    for name, run in corpus_pipeline.STAGES:
        got = run(spark, some, folder)
        assert name == "mixing" or got.columns == list(corpus_pipeline.COLUMNS)
        assert got.count() > 100
