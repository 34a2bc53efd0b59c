"""Benchmark decontamination.

Documents are compared with each benchmark item through windows of the item's
length in words. A window and an item are sets of five-word shingles with their
occurrence (the second of equal shingles is an element of its own), so that the
weighted Jaccard similarity (weights are counts) is that of the sets. Their SimHash of ``BITS`` bits
is the signs of the elements' summed bits, ties broken by a fixed half vote. Fingerprints within
``RADIUS`` bits are found through a multi-index over ``BLOCKS`` bit blocks: of two fingerprints within the radius, one
block at least differs by ``RADIUS // BLOCKS`` bits or fewer, so looking up every block's
neighbours misses none. Candidates are kept if their weighted Jaccard similarity, computed exactly, is
``SIMILARITY`` or more. At a similarity of 0.8 or more a fingerprint lies beyond the radius
with a chance of 2 in 100,000 or less (equal sizes, by the binomial distribution).

Two exact bounds come first: a window of which fewer positions hold a shingle of an item than
the similarity needs is not fingerprinted; a text shorter than the item is one
window and is compared exactly.

The items are broadcast, in portions of at most ``ITEMS`` items or
``ITEM_BYTES`` bytes; each portion is a pass over the documents.

Cases: null and empty texts and items match nothing; an item of fewer than five
words is one shingle; a text shorter than the item is its own window; equal
items are all reported; equal documents are reported each; ties between windows go
to the first; a null item id is reported as null; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, chunks, expand, gram_hashes, mix, row_key, stored, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS, RADIUS, BLOCKS = 256, 63, 16
ITEMS = 4096
ITEM_BYTES = 16 << 20
#: Window starts that are fingerprinted at a time lie within so many words.
SPAN = 4096
#: Fingerprints that are looked up at a time.
LOOKUPS = 64
WORDS = BITS // 64


def element_bits(elements: np.ndarray) -> np.ndarray:
    """+-1 for each of the ``BITS`` bits of each element."""
    parts = np.stack([mix(elements ^ np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64)) for k in range(WORDS)], axis=1)
    return np.unpackbits(parts.view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def occurrences(grams: np.ndarray) -> np.ndarray:
    """How many equal shingles come before each."""
    order = np.argsort(grams, kind="stable")
    same = np.concatenate([[False], grams[order][1:] == grams[order][:-1]])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(grams))))
    out = np.empty(len(grams), np.int64)
    out[order] = np.arange(len(grams)) - first
    return out


def elements(grams: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return grams + occurrence.astype(np.uint64) * BASE


def signs(total: np.ndarray) -> np.ndarray:
    """Fingerprints, as 64-bit numbers, of summed bits; a tie falls by a fixed half vote."""
    half = np.arange(BITS) % 2
    return np.packbits(2 * total + 2 * half - 1 > 0, axis=1, bitorder="little").view(np.uint64)


def fingerprints(grams: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each start, by running sums; windows with equal shingles are corrected for occurrences."""
    total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(element_bits(grams), axis=0, dtype=np.int32)])
    total = total[starts + count] - total[starts]
    order = np.argsort(grams, kind="stable")
    near = np.flatnonzero((grams[order][1:] == grams[order][:-1]) & (np.diff(order) < count))
    if len(near):  # some window has equal shingles
        # Windows that hold both of two equal neighbours.
        marks = np.zeros(len(grams) + 2, np.int64)
        np.add.at(marks, np.maximum(order[near + 1] - count + 1, 0), 1)
        np.add.at(marks, order[near] + 1, -1)
        for i in np.flatnonzero(np.cumsum(marks)[starts] > 0).tolist():
            own = grams[starts[i] : starts[i] + count]
            again = occurrences(own)
            twice = again > 0
            total[i] += (element_bits(elements(own[twice], again[twice])).sum(axis=0, dtype=np.int32) - element_bits(own[twice]).sum(axis=0, dtype=np.int32))
    return signs(total)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))
    most = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / most) if most else 0.0


def needed(count: int, similarity: float) -> int:
    """The least number of a window's ``count`` shingles that an item of as many has, at this similarity."""
    return int(np.ceil(2 * similarity * count / (1 + similarity) - 1e-9))


class MultiIndex:
    """Fingerprints by the values of their bit blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.width = prints, radius, BITS // blocks
        values = np.arange(1 << self.width, dtype=np.uint32)
        self.masks = values[np.bitwise_count(values) <= radius // blocks]  # what a block of a neighbour may differ by
        own = self._values(prints)
        self.order = [np.argsort(own[:, k], kind="stable") for k in range(blocks)]
        self.first = [np.searchsorted(own[order, k], np.arange((1 << self.width) + 1)).astype(np.int32) for k, order in enumerate(self.order)]

    def _values(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view({8: np.uint8, 16: np.uint16}[self.width]).reshape(len(prints), BITS // self.width).astype(np.uint32)

    def within(self, prints: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, indexed fingerprint) of the pairs within the radius, in order; ``wanted`` marks those of the index that matter."""
        found = []
        for start in range(0, len(prints), LOOKUPS):
            own = self._values(prints[start : start + LOOKUPS])
            pairs = []
            for k, (order, first) in enumerate(zip(self.order, self.first, strict=True)):
                near = own[:, k, None] ^ self.masks[None, :]
                low, high = first[near], first[near + 1]
                at, which = np.nonzero(high > low)
                counts = (high - low)[at, which].astype(np.int64)
                items = order[expand(low[at, which].astype(np.int64), counts)]
                found_pairs = np.repeat(at, counts) * len(self.prints) + items
                pairs.append(found_pairs if wanted is None else found_pairs[wanted[items]])
            both = np.unique(np.concatenate(pairs))
            at, item = both // len(self.prints), both % len(self.prints)
            close = np.bitwise_count(prints[start + at] ^ self.prints[item]).sum(axis=1) <= self.radius
            found.append((start + at[close], item[close]))
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, np.int64),) * 2


class Items:
    """An index over a portion of the benchmark."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS, blocks: int = BLOCKS):
        hashes, offsets = word_hashes(pa.array(texts, pa.string()), lower=True)
        self.ids, self.words, self.shingles, prints = [], [], [], []
        for item, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b > a:
                grams = gram_hashes(hashes[a:b], min(SHINGLE, b - a))
                self.ids.append(item)
                self.words.append(b - a)
                self.shingles.append(grams)
                prints.append(fingerprints(grams, np.zeros(1, np.int64), len(grams))[0])
        self.sizes = np.array(self.words, np.int64)
        self.index = MultiIndex(np.array(prints, np.uint64).reshape(-1, WORDS), radius, blocks)
        pairs = [(g, j) for j, x in enumerate(self.shingles) for g in np.unique(x).tolist()]
        pairs.sort()
        self.keys = np.array([g for g, _ in pairs], np.uint64)
        self.owner = np.array([j for _, j in pairs], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        maybe = np.flatnonzero(self.seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.keys):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, grams[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == grams[maybe]]

    def matches(self, words: np.ndarray, places: np.ndarray, grams: np.ndarray, shingle: int, similarity: float) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the items that one document holds. ``places`` are its hits in ``grams``."""
        first, last = np.searchsorted(self.keys, grams[places]), np.searchsorted(self.keys, grams[places], side="right")
        touched = np.unique(self.owner[expand(first, last - first)])
        best: dict[int, tuple[float, int]] = {}

        def verify(j: int, s: int, count: int) -> None:
            sim = weighted_jaccard(grams[s : s + count], self.shingles[j])
            if sim >= similarity and (j not in best or sim > best[j][0]):
                best[j] = (sim, s)

        for size in np.unique(self.sizes[touched]).tolist():
            if min(size, SHINGLE) != shingle:
                continue
            if len(words) < size:
                if len(words) >= shingle:
                    for j in touched[self.sizes[touched] == size].tolist():
                        verify(j, 0, len(grams))
                continue
            count = size - shingle + 1  # shingles of a window
            final = len(words) - size
            marks = np.zeros(final + 2, np.int64)
            np.add.at(marks, np.clip(places - count + 1, 0, final), 1)
            np.add.at(marks, np.minimum(places, final) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks)[: final + 1] >= needed(count, similarity))
            for part in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1) if len(starts) else ():
                low, high = int(part[0]), int(part[-1]) + count
                # Windows of one size are looked up among the items of that size.
                at, found = self.index.within(fingerprints(grams[low:high], part - low, count), self.sizes == size)
                for i, j in zip(at.tolist(), found.tolist(), strict=True):
                    verify(j, int(part[i]), count)
        return [(j, *best[j]) for j in sorted(best)]


def _portion(docs: DataFrame, rows: list, similarity: float) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        shingles = sorted({min(SHINGLE, n) for n in items.words})
        for batch in batches:
            for a, b in chunks(batch["text"]):
                part = batch.slice(a, b - a)
                hashes, offsets = word_hashes(part["text"], lower=True)
                out: list[tuple[int, int, float, int]] = []
                for n in shingles:
                    grams = gram_hashes(hashes, n)
                    hits = items.hits(grams)
                    owner = np.searchsorted(offsets, hits, side="right") - 1
                    inside = hits + n <= offsets[owner + 1]  # shingles within one document
                    hits, owner = hits[inside], owner[inside]
                    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(1, int)
                    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        doc = int(owner[x])
                        begin, end = int(offsets[doc]), int(offsets[doc + 1])
                        own = grams[begin : end - n + 1]
                        out += [(doc, j, sim, s) for j, sim, s in items.matches(hashes[begin:end], hits[x:y] - begin, own, n, similarity)]
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(at), part["key"].take(at), pa.array([items.ids[x[1]] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64())], ["doc_id", "key", "item_id", "similarity", "first_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key long, item_id long, similarity double, first_word long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (of the row), item_id, similarity, first_word of each document and item it holds."""
    base = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    portions = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    if portions == 1:
        return _portion(base, items.collect(), similarity)
    found = None
    for k in range(portions):  # one broadcast portion at a time
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k).collect()
        part = stored(_portion(base, rows, similarity))
        found = part if found is None else found.unionByName(part)
    return found
