"""Alignment of two tokenizers against the public libraries run on whole texts and all pairs of tokens."""

import hashlib
import json
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from fringelake.llm import align, queries

SCHEMA = "doc_id long, text string, links string, rid long, n_a long, pair string"
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(align.BYTE_LEVEL), reason="no tokenizer files")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    with open(align.BYTE_LEVEL) as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in plain}
    for x in range(256):
        if x not in plain:
            table[chr(256 + len(table) - len(plain))] = x
    docs = []
    for i, text in rows:
        want = (" " + (text or "")).encode()
        ai = a.encode(want.decode(), add_special_tokens=False).ids if text else []
        bi = b.encode(text) if text else []
        ab = [bytes(table[c] for c in names[x]) for x in ai]
        bb = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, bi)]
        if b"".join(ab) != want or b"".join(bb) != want:
            ai, bi, ab, bb = [], [], [], []
        spans = []
        for parts in (ab, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links, k = [], 0
        for x, (s, e) in enumerate(spans[0]):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((ai[x], bi[j]))
                j += 1
        groups, s, t = [], 0, 0
        ends = [{e: k for k, (_, e) in enumerate(x)} for x in spans]
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ai[s:x])) + "|" + ",".join(map(str, bi[t:y])))
            s, t = x, y
        docs.append((i, ai, bi, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((i, len(ai), len(bi), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if ai else "") for i, ai, bi, g, ls in docs), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)
    return sorted(map(tuple, align.cross_align(docs, **options).select(*COLUMNS).collect()), key=repr)


def corpus():
    rng = random.Random(6)
    words = ["the", "The", "señor", "größer", "naïve", "日本語", "🙂", "x", "==", "don't", "3.14", "2024", "\n", "\n\n", "\t", "  ", "   y", "a b", "<s>", "</s>", "<|endoftext|>", "<0x41>", "é" * 3, "Ⅷ", "…", "supercalifragilistic", "é", "​", "\x1c", "\x85"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    special = [None, "", " ", "  ", "   ", " lead", "trail ", "trail  ", "\n", "\n \n", "a \n b", "a\n  b", "a\t 　 b", "▁literal mark", "x▁", "no spaces" + "=" * 3000, "word " * 30000, "a" * 20000, "ab  " * 50, "same", "same", " same", "\x00 zero", "\x1c x", "a\x85 b"]
    return rows + [(1000 + i, t) for i, t in enumerate(special)] + [(None, "null id"), (7, rows[7][1])]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_against_all_pairs(spark, frequent):
    rows = corpus()
    want = brute(rows)
    assert any(w[1] == 0 for w in want) and run(spark, rows, frequent=frequent) == want


def test_forgetting_changes_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus() if t]
    encoder = align.Encoder(*(open(p, "rb").read() for p in (align.BYTE_LEVEL, align.PIECES)))
    assert encoder.cuts
    ids = pa.array([i for i, _ in rows])

    def tokens(batch):
        """Ids and ends of both sides, by document."""
        units, docs = batch["units"][0].as_py(), batch["docs"][0].as_py()
        out = []
        for d in docs:
            sides = [], [], [], []
            for c in d["codes"]:
                for side, name in zip(sides, ("a_ids", "a_ends", "b_ids", "b_ends"), strict=True):
                    side += units[c][name]
            assert (d["n_a"], d["n_b"]) == (len(sides[0]), len(sides[2]))
            out.append((sides[0], sides[2]))
        return out

    whole = tokens(align._encoded(encoder, ids, [t for _, t in rows]))
    monkeypatch.setattr(align, "UNITS", 5)
    monkeypatch.setattr(align, "AT_ONCE", 3)
    apart = [x for i, (_, t) in enumerate(rows) for x in tokens(align._encoded(encoder, ids[i : i + 1], [t]))]
    encoder.clear()
    encoder.cuts = False
    uncut = tokens(align._encoded(encoder, ids, [t for _, t in rows]))
    with open(align.BYTE_LEVEL, "rb") as f:
        assert align.by_rank(f.read())
    ranked = align.Encoder(*(open(p, "rb").read() for p in (align.BYTE_LEVEL, align.PIECES)), True)
    assert whole == apart == uncut == tokens(align._encoded(ranked, ids, [t for _, t in rows]))


def test_vocabularies_that_ranks_do_not_tell_are_known():
    import json

    with open(align.BYTE_LEVEL) as f:
        model = json.load(f)
    swapped = json.loads(json.dumps(model))
    swapped["model"]["merges"][5], swapped["model"]["merges"][500] = swapped["model"]["merges"][500], swapped["model"]["merges"][5]
    spaced = json.loads(json.dumps(model))
    spaced["pre_tokenizer"]["add_prefix_space"] = True
    assert not align.by_rank(json.dumps(swapped).encode()) and not align.by_rank(json.dumps(spaced).encode())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, None)], [(i, "same text") for i in range(9)]], ids=["empty", "null", "no text", "one text"])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_python_only_tokenises(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = align.align(align.encode(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("MapInArrow", "").replace("PythonUDF", "")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no synthetic tables")
def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, SF).select(*COLUMNS).collect()), key=repr) == brute(rows)
