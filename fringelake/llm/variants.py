"""Spelling variants: words of a corpus, which of them differ by one code point, and the usual form of each.

1. Runs of letters are counted, batch by batch, and summed by word.
2. Words at distance one are found by a self-join of the vocabulary's trie with
   active-node sets: the active nodes of a node are those within distance one of it; a
   child's set follows from its parent's, and at a node that ends a word every
   active node that ends another word is a pair.
3. The trie is partitioned by prefix. An edit leaves the first or the last half of the
   shorter word alone, so a pair shares a prefix in the trie of the words or in
   that of the words read backwards: each word goes to the partition of its first and
   to that of its last half, for its own length and for one less. A pair belongs to
   the first partition if its common prefix fills that half, and else to the second, so
   it is found once. Partitions above ``most_nodes`` trie nodes are divided
   in the same way by the rest of their words, again and again: at the end only one free
   code point is left, so that no partition can stay large.
4. A partition's pairs are summed by word; forms are followed by pointer doubling: a
   form has five times the occurrences, so chains are as short as a logarithm.

Cases: null and empty texts have no words; a null id counts as the empty text in
the checksum; equal rows each count; of near words with equal counts the first
in code-point order is the form; very long texts are read in pieces that end between
words; a word of any length takes part; an empty table gives no rows; extra
columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SHORTEST, FEWEST, DAMAGE, TIMES = 6, 5, 199, 5
#: Trie nodes of a partition at most (about 300 bytes each), where division can reach it.
MOST_NODES = 200_000
#: Distinct words that a task holds before it passes their counts on, and code points of a text read at once.
HELD, PIECE = 200_000, 1 << 20
FREE = 2**31 - 1
_LONG = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_BREAK = re.compile("[^a-zÀ-ÿ]")


def _runs(text: str) -> Iterator[list[str]]:
    """Long runs of letters with A-Z in lower case, in lists of bounded size."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        gap = _BREAK.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield _LONG.findall(text, at, end)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    crc = zlib.crc32
    for batch in batches:
        for doc, text in zip(batch["id"], batch["text"], strict=True):
            mark = crc(f"{doc.as_py()}:".encode())
            for runs in _runs(text.as_py()):
                for run, k in Counter(runs).items():
                    h = crc(run.encode(), mark)
                    if h % DAMAGE == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    total[run] += k
                if len(total) >= HELD:
                    yield out()
    yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of the words with enough code points and occurrences, as a stored table."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").filter("text is not null")
    return stored(texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEWEST))


def _divided(rows: DataFrame) -> DataFrame:
    """Each row of a partition twice: by the first and by the last half of what is free in the shorter words."""
    half = F.expr("int((size - front - back) / 2)")
    first = F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("until").alias("until"))
    last = F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), F.least("until", F.col("front") + half).alias("until"))
    rows = rows.select("word", "n", "size", F.explode(F.array(first, last)).alias("to")).select("word", "n", "size", "to.*")
    head, tail = F.expr("left(word, front)"), F.expr("right(word, back)")
    return rows.withColumn("part", F.concat_ws("|", "size", "front", "back", "until", head, tail))


def partitions(words: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """word, n, part: the words of each partition of the trie and of its mirror image."""
    sizes = F.expr(f"filter(array(length(word) - 1, length(word)), x -> x >= {SHORTEST})")
    rows = words.select("word", "n", F.explode(sizes).alias("size"), F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(FREE).alias("until"))
    rows, done = _divided(rows), None
    while True:
        nodes = F.sum(F.length("word") - F.col("front") - F.col("back"))
        large = rows.filter("size - front - back >= 2").groupBy("part").agg(nodes.alias("nodes"), F.count(F.lit(1)).alias("n")).filter((F.col("nodes") > most_nodes) & (F.col("n") > 1)).select("part")
        large = stored(large)
        if large.isEmpty():
            discard(large)
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(_divided(rows.join(large, "part", "left_semi")))


def near_pairs(rests: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) for all ordered pairs of distinct strings at distance one: the trie's self-join with active-node sets."""
    kids: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, rest in enumerate(rests):
        at = 0
        for c in rest:
            down = kids[at].get(c)
            if down is None:
                down = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = down
        ends[at] = i
    # At distance 0 a node's only active node is itself; ``active`` has those at distance 1.
    open_nodes: list[tuple[int, list[int]]] = [(0, list(kids[0].values()))]
    while open_nodes:
        node, active = open_nodes.pop()
        i = ends[node]
        if i >= 0:
            for other in active:
                if ends[other] >= 0:
                    yield i, ends[other]
        own = kids[node]
        for c, child in own.items():
            near = {node}  # c is inserted
            near.update(own.values())  # c is replaced
            near.update(kids[child].values())  # the next one is deleted
            for other in active:
                down = kids[other].get(c)
                if down is not None:
                    near.add(down)
            near.discard(child)
            open_nodes.append((child, list(near)))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, form, form_n of each partition's pairs; rows come sorted by partition."""
    out: list[tuple] = []

    def join(part: str, words: list[str], counts: list[int]) -> None:
        if len(words) < 2:
            return
        size, front, back, until = map(int, part.split("|")[:4])
        near: dict[int, list[int]] = defaultdict(list)
        for i, j in near_pairs([w[front : len(w) - back] for w in words]):
            a, b = words[i], words[j]
            if min(len(a), len(b)) == size and (until == FREE or _common(a, b) < until):
                near[i].append(j)
        for i, found in near.items():
            n, form = min((-counts[j], words[j]) for j in found)
            out.append((words[i], len(found), form, -n))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])

    now, words, counts = None, [], []
    for b in batches:
        for part, word, n in zip(b["part"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    join(now, words, counts)
                now, words, counts = part, [], []
                if len(out) >= HELD:
                    yield batch()
            words.append(word)
            counts.append(n)
    if now is not None:
        join(now, words, counts)
    yield batch()


def near_words(words: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """word, n_near, form, form_n for every word that has a near word: their number and the most frequent one."""
    rows = partitions(words, most_nodes).select("part", "word", "n").repartition("part").sortWithinPartitions("part")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = rows.mapInArrow(_joined, "word string, n_near long, form string, form_n long").groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of a stored table of word and form without cycles: the last form that is reached."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = count_words(docs)
    near = words.join(near_words(words, most_nodes), "word", "left")
    usual = F.col("form_n") >= TIMES * F.col("n")
    found = stored(near.select("word", F.when(usual, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("form_n")).alias("form_n")))
    last = roots(found.filter("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
