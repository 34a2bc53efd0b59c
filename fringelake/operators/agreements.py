"""Which images agree with each other: pairs above a cut, and the maximal sets of which all do.

Pairs come from blocks of images, a row each of a stored table: each block meets itself and every later one as a product of two
matrices, so that a task passes on only what is above the cut. Spark's cross join reads the table's parts again for each
pair of parts: no image is written more than twice, however many blocks it meets.
Maximal sets (cliques) are found from one root each: the sets whose first member, in order
of rising degree, is that root. A root needs its neighbours and the links among them,
as bit sets; roots are dealt over the tasks, and no set is found twice. Blocks of nodes with their
neighbours are stored and meet like blocks of images, so that a link sends one row, which neighbours of its
first end are neighbours of its second too, and not a row for every path of two links. Roots go in rounds of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.common import discard, expand, stored

#: The most images of a block, and about as many blocks are in a file of the stored table.
BLOCK, FILE_BLOCKS = 1024, 16
#: A block of nodes ends at so many nodes or neighbours; a task's table or bits have about so many cells; a round of roots sends so many bytes at most, with so many a row besides its bits.
NODES, ENTRIES, CELLS, ROUND, ROW_BYTES = 2048, 1 << 18, 1 << 22, 1 << 30, 24


def pairs(images: DataFrame, cut: float, blocks: int | None = None) -> DataFrame:
    """(a, b, value) with a < b: normalised cross correlation of all pairs of (image_id, pix) that reach ``cut``.

    Images that are null, constant, or hold nulls or non-finite pixels agree with none; images of one id are told apart by nothing and are
    compared like others, but an id is never paired with itself. All images have as many pixels as those that they are compared with.
    """
    whole = F.expr("size(pix) > 0 and forall(pix, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    own = images.select(F.col("image_id").cast("long").alias("id"), F.col("pix").cast("array<double>").alias("pix")).filter(whole & F.col("id").isNotNull())
    parts = max(blocks or 1, -(-own.count() // (FILE_BLOCKS * BLOCK)))
    packed = stored(own.repartition(parts, F.xxhash64("id")).mapInArrow(_packing(BLOCK), "block long, size int, ids binary, rows binary"))
    other = packed.select(F.col("block").alias("block2"), F.col("size").alias("size2"), F.col("ids").alias("ids2"), F.col("rows").alias("rows2"))
    # Not "size = size2": that is a key to join by, and all blocks of one size would go to one task.
    met = packed.crossJoin(other).filter((F.col("block") <= F.col("block2")) & (F.col("size") <= F.col("size2")) & (F.col("size") >= F.col("size2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, size, *data in zip(*(batch[c] for c in ("block", "block2", "size", "ids", "rows", "ids2", "rows2")), strict=True):
                a, m, b, k = (np.frombuffer(x.as_buffer(), t) for x, t in zip(data, (np.int64, np.float64) * 2, strict=True))
                values = m.reshape(len(a), size.as_py()) @ k.reshape(len(b), size.as_py()).T
                i, j = np.nonzero(values >= cut)
                fit = a[i] < b[j] if p == q else a[i] != b[j]
                i, j = i[fit], j[fit]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(values[i, j])], ["a", "b", "value"])

    return met.mapInArrow(run, "a long, b long, value double")


def _packing(most: int):
    """Blocks of up to ``most`` images of one size: their ids, and their pixels less the mean, of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, {}

        def out(size: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = zip(*held.pop(size), strict=True)
            m = np.array(rows)
            m -= m.mean(1, keepdims=True)
            norm = np.sqrt((m**2).sum(1, keepdims=True))
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            block, made = (TaskContext.get().partitionId() << 32) + made, made + 1
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "size", "ids", "rows"])

        for batch in batches:
            flat, offsets = batch["pix"].values.to_numpy(), batch["pix"].offsets.to_numpy()
            for k, i in enumerate(batch["id"].to_pylist()):
                size = int(offsets[k + 1] - offsets[k])
                held.setdefault(size, []).append((i, np.array(flat[offsets[k] : offsets[k + 1]])))
                if len(held[size]) == most:
                    yield out(size)
        for size in list(held):
            yield out(size)

    return run


def _maximal(first: int, later: int, earlier: int, near: list[int]) -> Iterator[int]:
    """Bit sets of the maximal cliques of ``later`` and ``first``, which no member of ``earlier`` could join."""
    stack = [(1 << first if first >= 0 else 0, later, earlier)]
    while stack:
        chosen, open_, shut = stack.pop()
        if not open_:
            if not shut:
                yield chosen
            continue
        # The one with most open neighbours is the pivot: only those it misses need a branch.
        rest, best, pivot = open_ | shut, -1, 0
        while rest:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            n = (near[i] & open_).bit_count()
            if n > best:
                best, pivot = n, i
        todo = open_ & ~near[pivot]
        while todo:
            bit = todo & -todo
            i = bit.bit_length() - 1
            todo ^= bit
            stack.append((chosen | bit, open_ & near[i], shut & near[i]))
            open_ ^= bit
            shut |= bit


def cliques(links: DataFrame) -> DataFrame:
    """(members): the maximal sets of at least two that are all linked, of links (a, b), each set sorted; repeated links and loops count for nothing."""
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = links.filter("a <> b").select(turned.alias("e")).select(F.col("e.a").cast("long").alias("a"), F.col("e.b").cast("long").alias("b"))
    packed = stored(both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_neighbours(NODES, ENTRIES), "block long, entries long, ids binary, counts binary, near binary"))
    total = packed.agg(F.sum("entries")).first()[0] or 0
    weights = sorted(packed.select("block", "counts").mapInArrow(_weights(total), "block long, weight double").collect())
    rounds = _rounds(weights, ROUND)
    found = [_around(packed.filter(F.col("block").between(*ends)), packed).mapInArrow(_sets, "members array<long>") for ends in rounds or [(0, 0)]]
    if len(found) == 1:
        return found[0]
    # Each round's shuffle goes when its sets are stored, so that one is on disk at a time.
    kept = [stored(x) for x in found]
    discard(packed)
    return links.sparkSession.read.schema("members array<long>").parquet(*(x.stored_path for x in kept))


def _rounds(weights: list[tuple[int, float]], most: float) -> list[tuple[int, int]]:
    """First and last block of runs of blocks, each of at most ``most`` weight or of one block."""
    out, held = [], 0.0
    for block, weight in weights:
        if out and held + weight <= most:
            out[-1], held = (out[-1][0], block), held + weight
        else:
            out, held = [*out, (block, block)], weight
    return out


def _neighbours(most: int, entries: int):
    """Blocks of nodes with their neighbours, of links sorted by both ends; a block ends at ``most`` nodes or with the node that takes it to ``entries`` neighbours."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        last, parts = 0, []
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            edges = (np.flatnonzero(np.diff(a)) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, len(a)], strict=True) if len(a) else ():
                if parts and a[start] != last:
                    yield last, np.unique(np.concatenate(parts))
                    parts = []
                last = int(a[start])
                parts.append(np.array(b[start:end]))
        if parts:
            yield last, np.unique(np.concatenate(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, near, size = 0, [], [], 0

        def out() -> pa.RecordBatch:
            data = [np.array(ids, np.int64), np.array([len(x) for x in near], np.int64), np.concatenate(near)]
            block = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["block", "entries", "ids", "counts", "near"])

        for node, others in runs(batches):
            ids.append(node)
            near.append(others)
            size += len(others)
            if len(ids) == most or size >= entries:
                yield out()
                made, ids, near, size = made + 1, [], [], 0
        if ids:
            yield out()

    return run


def _weights(total: int):
    """At most so many bytes go out for a block's roots. A node of n neighbours has at most n after it in order, and at most total / n, for those have n neighbours or more themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(x.as_buffer(), np.int64).astype(float) for x in batch["counts"]]
            weight = [float((np.minimum(x, total / x) * (x / 8 + ROW_BYTES) + 8 * x).sum()) for x in n]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(weight, pa.float64())], ["block", "weight"])

    return run


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _around(roots: DataFrame, packed: DataFrame) -> DataFrame:
    """(root, place, data), sorted within tasks: at place -1 the root's neighbours, and at the place of each neighbour after it in order, as bits, which of them are that one's too."""
    other = packed.select(*(F.col(c).alias(f"{c}2") for c in ("block", "ids", "counts", "near")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for batch in batches:
            for p, q, *data in zip(*(batch[c] for c in ("block", "block2", "ids", "counts", "near", "ids2", "counts2", "near2")), strict=True):
                arrays = [np.frombuffer(x.as_buffer(), np.int64) for x in data]
                if held != p.as_py():
                    held, mine = p.as_py(), _Roots(*map(np.array, arrays[:3]))
                if p == q:
                    yield pa.RecordBatch.from_arrays([pa.array(mine.ids), pa.array(np.full(len(mine.ids), -1, np.int32)), _binaries(mine.near, mine.counts * 8)], ["root", "place", "data"])
                yield from mine.meet(*arrays[3:])

    rows = roots.select("block", "ids", "counts", "near").crossJoin(other).mapInArrow(run, "root long, place int, data binary")
    return rows.repartition("root").sortWithinPartitions("root", "place")


class _Roots:
    """A block of nodes with their neighbours, numbered among all that are near any of them."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, near: np.ndarray) -> None:
        self.ids, self.counts, self.near = ids, counts, near
        self.first = np.cumsum(counts) - counts
        self.all, self.number = np.unique(near, return_inverse=True)
        self.key = np.repeat(np.arange(len(ids)), counts) * len(self.all) + self.number

    def meet(self, ids: np.ndarray, counts: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the links from these roots to those of another block that come after them, by number of neighbours, then id."""
        row = np.repeat(np.arange(len(ids)), counts)
        root = np.minimum(np.searchsorted(self.ids, near), len(self.ids) - 1)
        after = np.where(self.counts[root] == counts[row], self.ids[root] < ids[row], self.counts[root] < counts[row])
        link = np.flatnonzero((self.ids[root] == near) & after)
        if not len(link):
            return
        root, x = root[link], row[link]
        place = np.searchsorted(self.key, root * len(self.all) + np.searchsorted(self.all, ids[x])) - self.first[root]
        number = np.minimum(np.searchsorted(self.all, near), len(self.all) - 1)
        shared = self.all[number] == near
        # So many rows of the other block are held as a table of booleans, and so many bits are made, at a time.
        height = max(1, CELLS // len(self.all))
        work = np.cumsum(self.counts[root])
        cuts = np.flatnonzero((np.diff(x // height) != 0) | (np.diff(work // CELLS) != 0)) + 1
        at, table = -1, None
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
            if x[start] // height != at:
                at = x[start] // height
                own = np.flatnonzero(shared & (row // height == at))
                table = np.zeros((height, len(self.all)), bool)
                table[row[own] - at * height, number[own]] = True
            u, sizes = root[start:end], self.counts[root[start:end]]
            width = (sizes + 7) // 8
            bits = np.zeros(int(width.sum()) * 8, bool)
            bits[expand((np.cumsum(width) - width) * 8, sizes)] = table[np.repeat(x[start:end] - at * height, sizes), self.number[expand(self.first[u], sizes)]]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[u]), pa.array(place[start:end].astype(np.int32)), _binaries(np.packbits(bits, bitorder="little"), width)], ["root", "place", "data"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal sets of roots, of rows of ``_around``."""

    def roots() -> Iterator[tuple[int, np.ndarray, list[int], list[bytes]]]:
        root = near = None
        places, data = [], []
        for batch in batches:
            for r, place, x in zip(*(batch[c].to_pylist() for c in ("root", "place", "data")), strict=True):
                if place < 0:
                    if places:
                        yield root, near, places, data
                    root, near, places, data = r, np.frombuffer(x, np.int64), [], []
                else:
                    places.append(place)
                    data.append(x)
        if places:
            yield root, near, places, data

    found, size = [], 0
    for root, others, places, data in roots():
        near = _both_ways(len(others), places, data)
        later = sum(1 << i for i in places)
        # Those before the root that are linked with none after it bar no set.
        earlier = sum(1 << i for i, x in enumerate(near) if x) & ~later
        for chosen in _maximal(-1, later, earlier, near):
            members = [root]
            while chosen:
                members.append(int(others[(chosen & -chosen).bit_length() - 1]))
                chosen &= chosen - 1
            found.append(sorted(members))
            size += len(members)
            if size >= ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])
                found, size = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])


def _both_ways(n: int, places: list[int], data: list[bytes]) -> list[int]:
    """Bit sets of n nodes, of those at ``places``; the others get the links that these have with them."""
    near = [0] * n
    for i, x in zip(places, data, strict=True):
        near[i] = int.from_bytes(x, "little")
    raw, given = np.frombuffer(b"".join(data), np.uint8).reshape(len(places), -1), set(places)
    step = max(1, CELLS // (8 * n))
    for start in range(0, raw.shape[1], step):
        part = np.unpackbits(raw[:, start : start + step], axis=1, bitorder="little").T
        turned = np.zeros((len(part), n), np.uint8)
        turned[:, places] = part
        lines = np.packbits(turned, axis=1, bitorder="little")
        for k in np.flatnonzero(part.any(1)).tolist():
            if 8 * start + k not in given:
                near[8 * start + k] = int.from_bytes(lines[k].tobytes(), "little")
    return near
