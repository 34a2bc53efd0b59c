"""N-gram Jaccard join by a prefix tree.

Documents are sets of distinct word shingles; equal sets are one node. Two nodes
link when ``100 * |intersection| >= percent * |union|``. The join is exact:

1. Shingles are ordered globally, rare ones first by a bounded count sketch of all
   documents, ties by hash; any order gives the same result. Prefixes and tries are in this order.
2. Linked sets share ``SHARED`` shingles (or all that a link takes, if those are fewer) among the
   first ``n - ceil(percent * n / 100) + SHARED`` of each. Those prefixes are posted and shuffled once,
   by shingle; shingles of one node
   only are dropped there. Shingles that the sketch calls hot are dealt by node and all kept.
3. A node is compared with one other of another component, the one that most of
   its postings, ``SHARED`` at least, name among their two ends. Nodes that this
   puts in one component need not be compared any more.
4. Postings that still hold several components give what is left to compare. Those of
   ``NARROW`` nodes or fewer name pairs of nodes, at most that many a posting; pairs that
   ``SHARED`` of them name are compared, for sets that meet by chance mostly share one. The nodes of
   wider ones go to blocks: a node's home is its widest posting; homes are split by hash,
   large components at a home get blocks of their own, and postings name pairs of blocks.
   Of a linked pair's first ``SHARED`` common shingles all have narrow postings, or one has a wide one.
   Pairs of one component, and those whose sizes and prefix places allow no
   link, are left out.
5. Nodes are compared through a trie of ordered sets: overlaps are counted once for a
   shared path, for all queries of the block together, and subtrees (queries) are pruned
   when what remains cannot reach the overlap that is needed. Blocks return
   links that join components, not every linked pair.

Cases: texts without words (null, empty) have no shingle and link with nothing;
fewer words than a shingle are one shingle; equal rows are documents
of one component; a null id never names a component unless all its ids are null;
extra columns are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, gram_hashes, mix, row_key, signed, stored, word_hashes
from .components import components

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 20
BLOCK = 64
#: Postings of more nodes are compared by blocks, so that the pairs of a posting stay bounded.
NARROW = 64
#: Prefixes are so long that linked sets share so many shingles of them.
SHARED = 3
#: A shingle is dealt to ``SALTS`` places if its bucket of the sketch counts more than ``HOT`` documents beyond ``HOT_MEANS`` times the mean.
HOT, HOT_MEANS, SALTS = 10_000, 16, 256
#: About so many nodes, and shingles, are a side of a pair of blocks.
SIDE, SIDE_SHINGLES = 256, 400_000
#: Bytes of the table that tells which query has which shingle.
TABLE_BYTES = 8 << 20
#: So many rows (56 bytes each or less) of the list of where texts are to be verified are broadcast in a round, about.
BROADCAST_NODES = 500_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = word_hashes(texts, lower=True)
    grams = gram_hashes(hashes, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = grams[a : b - n + 1] if b - a >= n else gram_hashes(hashes[a:b], b - a) if b > a else grams[:0]
        own = np.sort(own)
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    total = np.array([len(shingles)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(shingles).sum(dtype=np.uint64)
    return int(signed(mix(total))[0])


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + SHARED) if n else 0


class PrefixTree:
    """A trie of sets in the global order (rare ones first by ``counts``, a sketch), with edges of several elements.

    Elements are held as their places in the order of the tree's own elements.
    """

    def __init__(self, sets: list[np.ndarray], counts: np.ndarray | None = None):
        self.values = np.unique(np.concatenate(sets))
        common = np.zeros(len(self.values)) if counts is None else counts[(self.values & np.uint64(len(counts) - 1)).astype(np.int64)]
        self.rank = np.empty(len(self.values), np.int64)
        self.rank[np.lexsort((self.values, common))] = np.arange(len(self.values))
        placed = [self.places(s) for s in sets]
        order = sorted(range(len(sets)), key=[s.astype(">u4").tobytes() for s in placed].__getitem__)
        self.root = self._grow([(placed[i], i) for i in order], 0)

    def places(self, query: np.ndarray) -> np.ndarray:
        """The places of those elements that the tree has, in order."""
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        return np.sort(self.rank[at[self.values[at] == query]])

    def _grow(self, rows: list[tuple[np.ndarray, int]], depth: int) -> tuple:
        """(edge, members that end here, children, least size, greatest size) of the rows that share ``depth`` elements."""
        first, last = rows[0][0], rows[-1][0]
        limit = min(len(first), len(last))
        differ = first[depth:limit] != last[depth:limit]
        end = depth + int(differ.argmax()) if differ.any() else limit
        members = [i for s, i in rows if len(s) == end]
        children, start = [], len(members)
        while start < len(rows):
            head, stop = rows[start][0][end], start + 1
            while stop < len(rows) and rows[stop][0][end] == head:
                stop += 1
            children.append(self._grow(rows[start:stop], end))
            start = stop
        sizes = [len(s) for s, _ in rows]
        return first[depth:end], members, children, min(sizes), max(sizes)

    def linked(self, query: np.ndarray, percent: int) -> list[int]:
        """Members whose Jaccard similarity with the query is ``percent`` % or more."""
        size, own, found = len(query), self.places(query), []
        stack = [(self.root, 0, 0, 0)] if len(own) else []
        while stack:
            (edge, members, children, least, most), overlap, depth, passed = stack.pop()
            if len(edge):
                at = np.searchsorted(own, edge)
                overlap += int((own[np.minimum(at, len(own) - 1)] == edge).sum())
                depth += len(edge)
                passed = int(np.searchsorted(own, edge[-1], side="right"))
            # overlap / (size + s - overlap) >= percent / 100, at best for the least size below.
            if (100 + percent) * (overlap + min(len(own) - passed, most - depth)) < percent * (size + max(least, depth)):
                continue
            if members and (100 + percent) * overlap >= percent * (size + depth):
                found += members
            stack += [(child, overlap, depth, passed) for child in children]
        return found

    def joined(self, queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, its linked queries) of many queries: ``linked`` for all of them in one traversal."""
        step = max(1, TABLE_BYTES // (5 * len(self.values)))
        for start in range(0, len(queries), step):
            for member, found in self._joined(queries[start : start + step], percent):
                yield member, found + start

    def _joined(self, queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        sizes = np.array([len(q) for q in queries])
        has = np.zeros((len(self.values) + 1, len(queries)), np.int8)
        for i, q in enumerate(queries):
            has[self.places(q) + 1, i] = 1
        # so_far[v]: shingles of a query among the first v values of the tree.
        so_far = np.cumsum(has, axis=0, dtype=np.int32)
        everyone = np.arange(len(queries))
        stack = [(self.root, np.zeros(len(queries), np.int64), 0, 0, everyone)]
        while stack:
            (edge, members, children, least, most), overlap, depth, passed, who = stack.pop()
            if len(edge):
                at = edge + 1
                overlap = overlap + has[at].sum(axis=0, dtype=np.int64)[who]
                depth += len(edge)
                passed = int(at[-1])
            left = np.minimum((so_far[-1] - so_far[passed])[who], most - depth)
            able = (100 + percent) * (overlap + left) >= percent * (sizes[who] + max(least, depth))
            if not able.all():
                overlap, who = overlap[able], who[able]
            if not len(who):
                continue
            if members:
                found = who[(100 + percent) * overlap >= percent * (sizes[who] + depth)]
                if len(found):
                    yield from ((m, found) for m in members)
            stack += [(child, overlap, depth, passed, who) for child in children]


class Forest:
    """Which components have been joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them."""
    most = counts.max(initial=0)
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.int32) if most <= np.iinfo(t).max)).tobytes()


def _counts(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(packed) // size])


def frequency_sketch(docs: DataFrame, n: int, bits: int = SKETCH_BITS, pieces: int = 256) -> np.ndarray:
    """How many documents have a shingle of each bucket; 2**bits counts whatever the input."""
    size = (1 << bits) // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for a, b in chunks(batch["text"]):
                sets = [s & np.uint64((1 << bits) - 1) for s in shingle_sets(batch["text"].slice(a, b - a), n)]
                if sets:
                    total += np.bincount(np.concatenate(sets).astype(np.int64), minlength=1 << bits).astype(np.int32)
        salt = int(total[:64].sum()) & 63
        parts = [_packed(x) for x in np.split(total, pieces)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["piece", "salt", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for x in rows["counts"]:
            total += _counts(x, size)
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "salt": rows["salt"].iloc[:1], "counts": [_packed(np.minimum(total, 2**31 - 1))]})

    schema = "piece int, salt int, counts binary"
    some = docs.select("text").mapInArrow(count, schema).groupBy("piece", "salt").applyInPandas(add, schema)
    out = np.zeros((pieces, size), np.int32)
    for r in some.groupBy("piece").applyInPandas(add, schema).collect():  # ``pieces`` rows
        out[r["piece"]] = _counts(r["counts"], size)
    return out.ravel()


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, sid, n) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch["text"]):
                part = batch.slice(a, b - a)
                sets = list(shingle_sets(part["text"], n))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "sid", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key long, sid long, n long")


def _postings(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(token, salt, sid, span) of the prefix of every node; span has n and the place, salt is 0 but for hot tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()
        mask = np.uint64(len(counts) - 1)
        hot = HOT + HOT_MEANS * counts.mean()
        for batch in batches:
            for a, b in chunks(batch["text"]):
                tokens, salts, ids, spans = [], [], [], []
                for s in shingle_sets(batch["text"].slice(a, b - a), n):
                    sid = set_id(s)
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    common = counts[(s & mask).astype(np.int64)]
                    take = np.lexsort((s, common))[: prefix_size(len(s), percent)]
                    tokens.append(s[take])
                    salts.append(np.where(common[take] > hot, 1 + sid % SALTS, 0))
                    ids.append(np.full(len(take), sid, np.int64))
                    spans.append((len(s) << 32) + np.arange(len(take), dtype=np.int64))
                flat = [np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((tokens, np.uint64), (salts, np.int32), (ids, np.int64), (spans, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(flat[0])), *map(pa.array, flat[1:])], ["token", "salt", "sid", "span"])

    return docs.select("text").mapInArrow(run, "token long, salt int, sid long, span long")


def _shared_postings(posted: DataFrame) -> DataFrame:
    """(token, sid, n, place, low, high) of the tokens of several nodes, each node once, after one shuffle; hot tokens are kept unseen.

    low and high are the posting's first and last node by id; those of a hot token, of the node's share of it.
    """
    once = posted.repartition("token", "salt").dropDuplicates(["token", "salt", "sid"])
    same = Window.partitionBy("token", "salt")
    end = F.struct(F.col("sid").alias("a"), F.col("span").alias("of"))
    several = once.withColumns({"low": F.min(end).over(same), "high": F.max(end).over(same)}).filter("low.a < high.a or salt > 0")
    return several.select("token", "sid", *_unpacked("span", "n", "place"), "low", "high")


def _unpacked(span: str, n: str, place: str) -> list:
    return [F.shiftright(span, 32).cast("int").alias(n), F.col(span).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias(place)]


def _star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each node b, the end of its postings that most of them name and allow; ids are hashes, so ends are random nodes."""
    ends = postings.select(F.col("sid").alias("b"), "n", "place", F.explode(F.array_distinct(F.array("low", "high"))).alias("c"))
    stars = ends.select("b", "n", "place", F.col("c.a").alias("a"), *_unpacked("c.of", "m", "at")).filter(F.col("a") != F.col("b"))
    votes = stars.filter(_may_link(percent)).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("votes")).filter(_enough("votes", percent))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")


def _rounds(places: DataFrame, count: int, base: DataFrame, reps: DataFrame, again: DataFrame) -> Iterator[DataFrame]:
    """``places`` (sid, g and more) with the text of each node, dealt by ``g`` to rounds of about ``BROADCAST_NODES`` of the ``count`` places.

    A round's list is broadcast, so that of the texts only the wanted ones are ever shuffled. ``reps`` has the key of one document of
    each node, ``again`` the keys of rows that are equal in id and text, which are sent once. A round must be over before the next is asked for.
    """
    rounds = max(1, -(-count // BROADCAST_NODES))
    dealt = places.join(reps, "sid").join(again.select("key", F.lit(True).alias("many")), "key", "left")
    wanted = stored(dealt.withColumns({"many": F.coalesce("many", F.lit(False)), "round": F.pmod(F.xxhash64("g", F.lit(41)), F.lit(rounds)).cast("int")}), by="round")
    texts, several = base.select("key", "text"), not wanted.filter("many").isEmpty()
    for k in range(rounds):
        found = texts.join(F.broadcast(wanted.filter(F.col("round") == k)), "key")
        if several:
            found = found.filter("not many").unionByName(found.filter("many").dropDuplicates(places.columns))
        yield found.select("text", *[x for x in places.columns if x != "sid"])
    discard(wanted)


def _compared(rounds: Iterator[DataFrame], run) -> DataFrame:
    """Links (a, b) that ``run`` finds among the rows of each ``g``, round by round: a round's shuffle files go before the next begins."""
    parts = [stored(rows.groupBy("g").applyInPandas(run, "a long, b long")) for rows in rounds]
    links = stored(reduce(DataFrame.unionByName, parts)) if len(parts) > 1 else parts[0]
    if len(parts) > 1:
        discard(*parts)
    return links


def _may_link(percent: int):
    """Whether sets of ``n`` and ``m`` shingles, one of whose first ``SHARED`` shared ones is at ``place`` and ``at``, may be linked."""
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    # A shared shingle bounds the overlap by those before it and what follows it in either set.
    return sized & ((F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + SHARED - 1) * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _enough(count: str, percent: int):
    """Whether sets of ``n`` and ``m`` shingles that share ``count`` of their prefixes may be linked."""
    return (F.col(count) >= SHARED) | (F.col(count) * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _near_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of different components that enough postings name and that may be linked."""
    other = open_.select("token", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("comp").alias("comp_b"))
    named = open_.withColumnRenamed("sid", "a").join(other, "token").filter((F.col("comp") < F.col("comp_b")) & _may_link(percent))
    return named.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("shared")).filter(_enough("shared", percent)).select("a", "b")


def _blocks(open_: DataFrame) -> DataFrame:
    """(sid, comp, n, block) of the nodes of ``open_``."""
    first = stored(open_.groupBy("sid", "comp", "n").agg(F.max_by("token", F.struct("width", "token")).alias("home")))
    # A component with a side's worth of nodes at a home has blocks of its own there.
    large = first.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("nodes")).filter(F.col("nodes") >= SIDE).select("home", "comp", F.col("comp").alias("own"))
    homes = stored(first.join(large, ["home", "comp"], "left").withColumn("own", F.xxhash64("home", "own")))
    parts = homes.groupBy("own").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(F.sum("n") / SIDE_SHINGLES)).alias("parts"))
    out = stored(homes.join(parts, "own").select("sid", "comp", "n", F.xxhash64("own", F.pmod(F.xxhash64("sid", F.lit(29)), F.col("parts"))).alias("block")))
    discard(first, homes)
    return out


def _block_pairs(open_: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The (x, y) of blocks between which, or within which (x = y), components may link."""
    named = open_.select("token", "sid", "n", "place").join(blocks.select("sid", "block"), "sid")
    ends = stored(named.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("reach")))
    several = ends.groupBy("token").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("token")
    ends = stored(ends.join(several, "token"))
    other = ends.select("token", F.col("block").alias("y"), F.col("least").alias("least_y"), F.col("most").alias("most_y"), F.col("reach").alias("reach_y"))
    sized = (F.col("most") * 100 >= F.col("least_y") * percent) & (F.col("most_y") * 100 >= F.col("least") * percent)
    # As in _may_link.
    near = (F.least("reach", "reach_y") + SHARED - 1) * (100 + percent) >= (F.col("least") + F.col("least_y")) * percent
    pairs = ends.withColumnRenamed("block", "x").join(other, "token").filter((F.col("x") < F.col("y")) & sized & near).select("x", "y").distinct()
    spans = stored(blocks.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")))
    span_x, span_y = (spans.select(F.col("block").alias(c), F.struct("low", "high").alias(f"span_{c}")) for c in "xy")
    one = (F.col("span_x.low") == F.col("span_x.high")) & (F.col("span_x") == F.col("span_y"))
    between = pairs.join(span_x, "x").join(span_y, "y").filter(~one).select("x", "y")
    return stored(between.unionByName(spans.filter("low < high").select(F.col("block").alias("x"), F.col("block").alias("y"))))


def _join_blocks(open_: DataFrame, base: DataFrame, reps: DataFrame, again: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """Links (a, b) that join the components of ``open_`` as far as its nodes are linked."""
    blocks = _blocks(open_)
    pairs = _block_pairs(open_, blocks, percent)
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    placed = stored(sides.join(blocks, "block").select("x", "y", "block", "sid", "comp"))
    count = placed.count()
    groups = max(1, -(-count // (2 * SIDE)))
    rounds = _rounds(placed.withColumns({"node": F.col("sid"), "g": F.pmod(F.xxhash64("x", "y"), F.lit(groups))}), count, base, reps, again)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for (x, y), own in rows.groupby(["x", "y"], sort=False):
            own = own.drop_duplicates(["block", "node"])
            first, second = own[own["block"] == x], own[own["block"] == y]
            queries = list(shingle_sets(pa.array(first["text"], pa.string()), n))
            sets = queries if x == y else list(shingle_sets(pa.array(second["text"], pa.string()), n))
            ids_a, comps_a = first["node"].to_numpy(), first["comp"].tolist()
            ids_b, comps_b = second["node"].to_numpy(), second["comp"].tolist()
            forest = Forest()
            for member, found in PrefixTree(sets, sketch.value).joined(queries, percent):
                for i in found.tolist():
                    if forest.join(comps_a[i], comps_b[member]):
                        out_a.append(ids_a[i])
                        out_b.append(ids_b[member])
        return pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")

    links = _compared(rounds, run)
    discard(blocks, pairs, placed)
    return links


def _verify(pairs: DataFrame, base: DataFrame, reps: DataFrame, again: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """The linked ones of ``pairs`` (a, b)."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = stored(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(13)), F.col("parts")).alias("part")))
    # Many small blocks share a task's group, for groups have a fixed cost.
    pairs_count = placed.count()
    groups = max(1, -(-pairs_count // (4 * BLOCK)))
    dealt = placed.withColumn("g", F.pmod(F.xxhash64("a", "part"), F.lit(groups)))
    # A block's query has a row of its own; texts go from the input to their groups at once, of both kinds together.
    others = dealt.select(F.col("b").alias("sid"), "g", "a", "part", "b", F.lit(False).alias("query"))
    queries = dealt.select(F.col("a").alias("sid"), "g", "a", "part", F.col("a").alias("b"), F.lit(True).alias("query")).distinct()
    rounds = _rounds(others.unionByName(queries), pairs_count + queries.count(), base, reps, again)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        queries = rows[rows["query"]].drop_duplicates(["a", "part"]).set_index(["a", "part"])["text"]
        for block, others in rows[~rows["query"]].drop_duplicates(["a", "b"]).groupby(["a", "part"], sort=False):
            sets = list(shingle_sets(pa.array(others["text"], pa.string()), n))
            query = next(shingle_sets(pa.array([queries[block]], pa.string()), n))
            found = PrefixTree(sets, sketch.value).linked(query, percent)
            out_a += [block[0]] * len(found)
            out_b += others["b"].to_numpy()[found].tolist()
        return pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")

    links = _compared(rounds, run)
    discard(placed)
    return links


def _open_postings(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings, with their node's component and their width, of the tokens that several components share."""
    if links.isEmpty():
        named = postings.withColumn("comp", F.col("sid"))
    else:
        named = postings.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("width")).filter("low < high").select("token", "width")
    return stored(named.join(stored(mixed), "token"))


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (of the row), comp (of its class), n_shingles, component_id for every document."""
    base = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    nodes = stored(_nodes(base, n))
    sketch = base.sparkSession.sparkContext.broadcast(frequency_sketch(base, n))
    postings = stored(_shared_postings(_postings(base, n, percent, sketch)))

    # Rows that are equal in id and text are sent to comparisons once.
    again = stored(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key"))
    reps = nodes.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key"))

    tried = stored(_star_pairs(postings, percent))
    links = _verify(tried, base, reps, again, n, percent, sketch)
    tested = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_ = _open_postings(postings.drop("low", "high"), links)
    discard(postings)
    rest = stored(_near_pairs(open_.filter(F.col("width") <= NARROW), percent).join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = stored(links.unionByName(_verify(rest, base, reps, again, n, percent, sketch)))
    wide = open_.filter(F.col("width") > NARROW)
    if not wide.isEmpty():
        links = stored(links.unionByName(_join_blocks(wide, base, reps, again, n, percent, sketch)))
    discard(tried, open_, rest, again)

    if links.isEmpty():
        found = nodes.withColumn("comp", F.col("sid"))
    else:
        comp = components(links)
        found = nodes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # Stored, so that the join with a hot component can be split.
    named = stored(found.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    return found.join(named, "comp", "left").select("doc_id", "key", "comp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
