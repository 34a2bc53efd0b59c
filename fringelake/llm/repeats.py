"""Substring dedup: seed and extend over winnowed anchors.

Every window of ``WINDOW`` words picks one of its ``GRAM``-word grams as its
anchor (the last of those with the least hash), so equal windows pick equal
anchors at equal places. The run of windows of one text that share an anchor is a seed; its
reach is the span these windows cover. Seeds are joined on their anchor:

* an anchor of one seed matches nothing;
* seeds of one anchor with equal reaches are a class, represented by one of them; the seeds
  of a class of several match each other over the whole reach;
* the representatives of an anchor's classes are joined with each other, and a match of two is
  extended from the anchor to the left and to the right, word by word, as far as both
  reaches go. Of the spans of ``WINDOW`` words or more the maximal ones are kept, and hold for all seeds
  of the class.

An anchor of more than ``WIDE`` classes is not joined pair by pair. Its representatives are sorted by the words after the
anchor and then by those before it; words that no neighbour has are cut off. The windows left over are told apart
within a batch, where neighbours have most of them in common, and each is counted once for a batch; windows
of one representative that follow each other make up a span. Counts are summed before they are
shuffled, no task gathers an anchor's seeds, and the joins meet two stored or scanned tables,
so that Spark can split a hot key.

Equal texts are one text to all this; a text that several rows have repeats as a whole if it has a
window.

Reaches are compared by 128 bits of hash (anchor and reach), words in extensions by 48, windows
of wide anchors by 128, texts by 64.

Cases: null and empty texts have no words and keep nothing (the hash of the
empty text); texts shorter than a window keep all; equal rows are separate
documents, each a repeat of the other; null ids are kept; extra columns are left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, discard, expand, gram_hashes, row_key, signed, span_hasher, stored, word_hashes

WINDOW = 35
GRAM = 8
#: The most classes of an anchor whose representatives are joined pair by pair.
WIDE = 64
#: Representatives that are extended in one group, about.
GROUP = 4000
#: Pairs that are extended at a time.
PAIRS = 100_000
#: Bytes of a word's hash that an extension compares.
WORD_BYTES = 6


def seeds(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window start, last window start, anchor's place, anchor hash) of each seed of a batch of documents."""
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - window + 1, 0)
    starts = expand(offsets[:-1], windows)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, gram)
    span = window - gram + 1
    # The last of the least: compare (hash, -position) by doubling spans; ties take the right one.
    low, at = grams, np.arange(len(grams))
    width = 1
    while width * 2 <= span:
        left, right = low[:-width], low[width:]
        take = right <= left
        low, at = np.where(take, right, left), np.where(take, at[width:], at[:-width])
        width *= 2
    if width < span:
        shift = span - width
        left, right = low[:-shift], low[shift:]
        take = right <= left
        at = np.where(take, at[shift:], at[:-shift])
    place = at[starts]
    document = np.repeat(np.arange(len(lengths)), windows)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return document[new], starts[new], starts[last], place[new], grams[place[new]]


def _unseen(keys: np.ndarray, seen: set) -> np.ndarray:
    """Which rows have a text that this task has not met; the set holds a number a text."""
    new = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            new[i] = True
    return new


def find_seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, reach, key, first, at, last): window starts and the anchor's place, counted from the text's first word."""
    names = ["anchor", "reach", "key", "first", "at", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch["text"]):
                part = batch.slice(a, b - a)
                part = part.filter(pa.array(_unseen(part["key"].to_numpy(zero_copy_only=False), seen)))
                hashes, offsets = word_hashes(part["text"])
                document, first, last, place, anchor = seeds(hashes, offsets, window, gram)
                reach = span_hasher(hashes)(first, last + window)
                base = offsets[document]
                keys = part["key"].to_numpy(zero_copy_only=False)[document]
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(reach)), pa.array(keys), *(pa.array((x - base).astype(np.int32)) for x in (first, place, last))], names)

    return docs.select("key", "text").mapInArrow(run, "anchor long, reach long, key long, first int, at int, last int")


def cut_reaches(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, reach, wide, left, words) of the seeds listed for each text: the words of the reach, ``left`` of them before the anchor."""
    names = ["anchor", "reach", "wide", "left", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch["text"]):
                part = batch.slice(a, b - a)
                part = part.filter(pa.array(_unseen(part["key"].to_numpy(zero_copy_only=False), seen)))
                hashes, offsets = word_hashes(part["text"])
                flat = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
                listed = part["seeds"]
                owner = np.repeat(np.arange(len(part)), np.asarray(listed.value_lengths().fill_null(0)))
                own = listed.flatten()
                field = {x: own.field(i) for i, x in enumerate(("first", "at", "last", "anchor", "reach", "wide"))}
                start = offsets[owner] + field["first"].to_numpy(zero_copy_only=False)
                stop = offsets[owner] + field["last"].to_numpy(zero_copy_only=False) + window
                left = pa.compute.subtract(field["at"], field["first"])
                words = pa.array([flat[WORD_BYTES * x : WORD_BYTES * y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([field["anchor"], field["reach"], field["wide"], left, words], names)

    return texts.select("key", "text", "seeds").mapInArrow(run, "anchor long, reach long, wide boolean, left int, words binary")


def _words(data) -> np.ndarray:
    """48-bit hashes of a reach's words."""
    out = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return out.view(np.uint64).ravel()


def _aligned(left: np.ndarray, words: list[np.ndarray], window: int, gram: int) -> np.ndarray:
    """One row a reach, aligned at the anchor; places beyond the reach hold a value of the row's own."""
    side, lengths = window - gram, np.array([len(x) for x in words], np.int64)
    table = np.repeat((np.arange(len(words), dtype=np.uint64) + np.uint64(1 << 63))[:, None], 2 * side + gram, axis=1)
    table[np.repeat(np.arange(len(words)), lengths), expand(side - left, lengths)] = np.concatenate(words)
    return table


def extend(anchor: np.ndarray, left: np.ndarray, words: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, words before the anchor, words after it) of the maximal matches of ``window`` words or more; seeds are sorted by anchor."""
    side = window - gram
    table = _aligned(left, words, window, gram)
    ends = np.searchsorted(anchor, anchor, side="right")
    partners = ends - 1 - np.arange(len(anchor))
    part = np.cumsum(partners) // PAIRS
    found = []
    for p in np.unique(part[partners > 0]):
        rows = np.flatnonzero((part == p) & (partners > 0))
        i, j = np.repeat(rows, partners[rows]), expand(rows + 1, partners[rows])
        same = table[i] == table[j]
        before = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
        after = np.cumprod(same[:, side + gram :], axis=1).sum(axis=1)
        good = (before + gram + after >= window) & same[:, side : side + gram].all(axis=1)
        found.append(np.stack([np.concatenate([i[good], j[good]]), np.tile(before[good], 2), np.tile(after[good], 2)]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    who, before, after = np.unique(np.concatenate(found, axis=1), axis=1)
    # By seed, longest to the left first: a span is maximal if it goes further right than those before it.
    order = np.lexsort((-after, -before, who))
    who, before, after = who[order], before[order], after[order]
    keep, furthest, last = [], -1, -1
    for n, (w, r) in enumerate(zip(who.tolist(), after.tolist(), strict=True)):
        if w != last:
            last, furthest = w, -1
        if r > furthest:
            keep.append(n)
            furthest = r
    return who[keep], before[keep], after[keep]


def _extended(window: int, gram: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "reach"]).sort_values("anchor", kind="stable").reset_index(drop=True)
        who, before, after = extend(rows["anchor"].to_numpy(), rows["left"].to_numpy(np.int64), [_words(x) for x in rows["words"]], window, gram)
        return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[who], "reach": rows["reach"].to_numpy()[who], "before": before, "after": after})

    return run


def shared(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """How many words, from the anchor on, each row of ``sides`` has in common with the row before or after it; rows are sorted by anchor and words.

    No other row has more, as rows are sorted. The first and the last row may go on elsewhere: all their words count.
    """
    same = (sides[1:] == sides[:-1]) & (anchor[1:] == anchor[:-1])[:, None]
    next_ = np.cumprod(same, axis=1).sum(axis=1)
    all_ = [sides.shape[1]]
    return np.maximum(np.concatenate([all_, next_]), np.concatenate([next_, all_]))


def _ahead(window: int, gram: int):
    """Reaches sorted by anchor and words after it, without the words after it that no other has; ``back``: the words before it, nearest first."""
    names, side = ["anchor", "reach", "left", "words", "back"], window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, left = batch["words"].to_pylist(), batch["left"].to_numpy()
            table = _aligned(left, [_words(x) for x in data], window, gram)
            ends = left + gram + shared(batch["anchor"].to_numpy(), table[:, side + gram :])
            words = [x[: WORD_BYTES * n] for x, n in zip(data, ends.tolist(), strict=True)]
            back = [np.frombuffer(x, f"V{WORD_BYTES}")[:n][::-1].tobytes() for x, n in zip(data, left.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch["anchor"], batch["reach"], batch["left"], pa.array(words, pa.binary()), pa.array(back, pa.binary())], names)
            yield out.filter(pa.array([len(x) >= WORD_BYTES * window for x in words]))

    return run


def _counted(window: int, gram: int):
    """Of reaches sorted by anchor and words before it, without those before it that no other has:

    (anchor, content, n, reach, before, null), a window and how many of the batch have it, with the reach if one, and
    (anchor, null, null, reach, before, after), the spans of a reach's windows that several of the batch have.
    """
    names, side = ["anchor", "content", "n", "reach", "before", "after"], window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            anchor, reach, left = (batch[x].to_numpy() for x in ("anchor", "reach", "left"))
            words = [_words(x) for x in batch["words"].to_pylist()]
            table = _aligned(left, words, window, gram)
            before = np.minimum(shared(anchor, table[:, :side][:, ::-1]), left)
            first, ends = np.cumsum([0, *map(len, words[:-1])]), np.array([len(x) for x in words])
            counts = np.maximum(ends - left + before - window + 1, 0)
            start = expand(left - before, counts)
            row = np.repeat(np.arange(len(words)), counts)
            content = signed(gram_hashes(np.concatenate(words), window)[first[row] + start])
            ahead = left[row] - start  # words of the window before the anchor
            order = np.lexsort((content, anchor[row]))
            new = np.concatenate([[True], (np.diff(content[order]) != 0) | (np.diff(anchor[row][order]) != 0)])[: len(order)]
            n = np.zeros(len(row), np.int64)
            runs = np.diff([*np.flatnonzero(new), len(order)])
            n[order] = np.repeat(runs, runs)
            one = order[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[row[one]]), pa.array(content[one]), pa.array(n[one]), pa.array(reach[row[one]], mask=n[one] > 1), pa.array(ahead[one].astype(np.int32)), pa.nulls(len(one), pa.int32())], names
            )
            # Windows of a row that follow each other make up a span.
            many = np.flatnonzero(n > 1)
            head = np.concatenate([[True], (np.diff(row[many]) != 0) | (np.diff(start[many]) != 1)])[: len(many)]
            tail = np.concatenate([head[1:], [True]])[: len(many)]
            a, b = many[head], many[tail]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[row[a]]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(reach[row[a]]), pa.array(ahead[a].astype(np.int32)), pa.array((side - ahead[b]).astype(np.int32))], names
            )

    return run


def _wide_spans(wide: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """(anchor, reach, before, after) of the repeats among the reaches of wide anchors, and the tables that it is read from.

    Words that a reach shares with no other of its anchor are cut off first, on either side: sorted, each needs a look at its neighbours only.
    """
    once = stored(wide.dropDuplicates(["anchor", "reach"]).withColumn("on", F.expr(f"substring(words, {WORD_BYTES} * (left + {gram}) + 1)")))
    keys = ["anchor", "on", "reach"]
    cut = stored(once.repartitionByRange(*keys).sortWithinPartitions(*keys).select("anchor", "reach", "left", "words").mapInArrow(_ahead(window, gram), "anchor long, reach long, left int, words binary, back binary"))
    keys = ["anchor", "back", "words", "reach"]
    found = stored(cut.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_counted(window, gram), "anchor long, content long, n long, reach long, before int, after int"))
    twice = stored(found.filter("n is not null").groupBy("anchor", "content").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"))
    single = found.filter("n = 1").join(twice, ["anchor", "content"]).withColumn("after", F.lit(window - gram) - F.col("before"))
    spans = found.filter("n is null").unionByName(single).select("anchor", "reach", "before", "after")
    return spans, [once, cut, found, twice]


def find_repeats(base: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, spans) of the texts of ``base`` (key, text) that hold repeats: (start, end) in words."""
    found = find_seeds(base, window, gram).withColumn("place", F.xxhash64("key", "first"))
    several = F.min("place") != F.max("place")
    anchors = stored(found.groupBy("anchor").agg(several.alias("several"), (F.min("reach") != F.max("reach")).alias("mixed")).filter("several").drop("several"))
    joined = stored(found.join(anchors, "anchor"))
    mixed = joined.filter("mixed").drop("mixed")
    classes = stored(mixed.groupBy("anchor", "reach").agg(several.alias("whole"), F.min(F.struct("key", "first", "at", "last")).alias("seed")))
    widths = stored(classes.groupBy("anchor").agg((F.count(F.lit(1)) > WIDE).alias("wide")))
    n_classes = classes.count()
    listed = classes.join(widths, "anchor").select("seed.*", "anchor", "reach", "wide")
    by_text = listed.groupBy("key").agg(F.collect_list(F.struct("first", "at", "last", "anchor", "reach", "wide")).alias("seeds"))
    reaches = stored(cut_reaches(base.join(by_text, "key"), window))
    grouped = reaches.filter("not wide").withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(max(1, n_classes // GROUP))))
    spans = grouped.groupBy("g").applyInPandas(_extended(window, gram), "anchor long, reach long, before int, after int")
    wide, tables = reaches.filter("wide"), []
    if not wide.isEmpty():
        more, tables = _wide_spans(wide, window, gram)
        spans = spans.unionByName(more)
    # A class of several seeds repeats over its whole reach.
    results = stored(spans.join(classes.filter("whole"), ["anchor", "reach"], "left_anti").unionByName(classes.filter("whole").select("anchor", "reach", F.lit(-1).alias("before"), F.lit(-1).alias("after"))))
    whole = F.col("before") < 0
    start = F.when(whole, F.col("first")).otherwise(F.col("at") - F.col("before"))
    end = F.when(whole, F.col("last") + window).otherwise(F.col("at") + gram + F.col("after"))
    covered = mixed.join(results, ["anchor", "reach"]).select("key", start.alias("start"), end.alias("end"))
    covered = covered.unionByName(joined.filter("not mixed").select("key", F.col("first").alias("start"), (F.col("last") + window).alias("end")))
    out = stored(covered.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(anchors, joined, classes, widths, reaches, results, *tables)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document.

    With ``keep_text`` also all columns of ``docs``, the text replaced by the
    kept words joined by blanks where any was removed; columns named like the results are replaced.
    """
    added = StructType.fromDDL("n_words long, n_removed long, kept_sha256 string")
    docs_columns = [x for x in docs.columns if x not in added.names] if keep_text else ["doc_id"]
    names = [*docs_columns, *added.names]
    own = {x: f"c{i}" for i, x in enumerate(dict.fromkeys([*docs_columns, "text"]))}  # no name clashes with ours
    full = docs.select(*[F.col(f"`{x}`").alias(c) for x, c in own.items()], row_key("text").alias("_key"))
    base = full.select(F.col("_key").alias("key"), F.col(own["text"]).alias("text"))
    spans = find_repeats(base, window, gram)
    copied = stored(base.filter(F.col("text").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied")))
    marks = spans.join(copied, "key", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            for text, found, copied in zip(batch[own["text"]], batch["spans"], batch["copied"].to_pylist(), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                left = words
                if copied and len(words) >= window:
                    left = []
                elif found.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, found.values.field(0).to_numpy(), 1)
                    np.add.at(edges, found.values.field(1).to_numpy(), -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                out = b" ".join(left)
                digests.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    kept.append(text.as_py() if len(left) == len(words) else out.decode("utf-8", "surrogatepass"))
            columns = [pa.array(kept, pa.string()) if x == "text" else batch[own[x]] for x in docs_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names)

    schema = StructType([*(docs.schema[x] for x in docs_columns), *added.fields])
    joined = full.join(marks.withColumnRenamed("key", "_key"), "_key", "left")
    return joined.select(*own.values(), "spans", "copied").mapInArrow(run, schema)
