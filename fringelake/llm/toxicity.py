"""Toxicity: a character n-gram linear classifier over naive Bayes log-count ratios.

Features are presences of hashed character n-grams, each scaled by its log-count
ratio between toxic and clean training texts; a logistic regression with an L2
penalty is fitted on the scaled features. Only n-grams whose presence differs
between the classes beyond chance (G statistic) carry weight.

The classifier is fitted on a bounded sample of labelled rows: at most
``sample_per_class`` of each class, those with the least hash of their id, and its
intercept is moved back to the ratio of the classes among all labels. Of near copies of one
label in the sample one counts, for a copied text must not count as evidence many times: rows are copies if
``COPY`` of their min-hashes of five-word shingles agree (``HASHES`` of them, an estimate of the
Jaccard similarity). The driver gets these min-hashes, counts of n-grams, and of each
row the n-grams that have weight. All documents are scored, over their whole text.

Cases: of several documents of one id one stands for it in the sample; null and empty texts get the model's score of a text with no feature;
documents with several labels count as toxic if one of them is; null labels are
none; without both classes, every score is the share of toxic among the labelled
(0 without labels); equal rows get equal scores; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .charfeat import BITS, presence
from .common import chunks, discard, gram_hashes, mix, stored, word_hashes

SIZES = range(3, 7)
SAMPLE_PER_CLASS = 2500
THRESHOLD = 0.3
G_LEAST = 24.0
SMOOTH = 0.5
PENALTY = 1.0
DIVISOR, HELD_OUT = 4, 2
#: Near copies among the sampled rows.
HASHES, COPY = 64, 0.8
PIECES = 64
#: Texts whose n-grams a worker holds at a time; a longer text is held by itself.
TEXT_BYTES = 1 << 19


def held_out(divisor: int, remainder: int):
    """crc32 of the id's text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor)) == remainder


def sketches(texts: pa.Array, words: int = 5, count: int = HASHES) -> list[list[int]]:
    """Min-hashes of each text's word shingles, to tell copies among the training rows."""
    hashes, offsets = word_hashes(texts, lower=True)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        grams = gram_hashes(hashes[a:b], min(words, max(1, b - a)))
        out.append([int(mix(grams ^ np.uint64(0x51ED270B * (i + 1))).min() >> np.uint64(1)) if len(grams) else 0 for i in range(count)])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch["text"], TEXT_BYTES):
            part = batch.slice(a, b - a)
            found = [x.astype(np.int32).tobytes() for x in presence(part["text"], SIZES)]
            yield pa.RecordBatch.from_arrays([part["row"], part["label"], pa.array(found, pa.binary()), pa.array(sketches(part["text"]), pa.list_(pa.int64()))], ["row", "label", "features", "sketch"])


def without_copies(rows: list) -> list:
    """The first of each group of copies with one label."""
    kept: dict[int, list[np.ndarray]] = {}
    out = []
    for r in rows:
        have, own = kept.setdefault(r["label"], []), np.array(r["sketch"])
        if not have or not ((np.array(have) == own).sum(axis=1) >= COPY * len(own)).any():
            out.append(r)
            have.append(own)
    return out


def _counts(bits: int):
    """In how many rows of each label each n-gram is, in ``PIECES`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            for label, found in zip(batch["label"].to_pylist(), batch["features"], strict=True):
                total[int(label > 0), np.frombuffer(found.as_buffer(), np.int32)] += 1
        parts = [x.tobytes() for x in np.split(total, PIECES, axis=1)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])

    return run


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "counts": [np.sum([np.frombuffer(x, np.int32) for x in rows["counts"]], axis=0, dtype=np.int32).tobytes()]})


def choose(p: np.ndarray, q: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The n-grams whose presence (in ``p`` toxic and ``q`` clean rows) differs beyond chance, by the G statistic."""
    n, g = float(toxic + clean), np.zeros(len(p))
    for seen, size in ((p, toxic), (q, clean)):
        for observed, expected in ((seen, (p + q) * size / n), (size - seen, (n - p - q) * size / n)):
            g += 2 * observed * np.log(np.where((observed > 0) & (expected > 0), observed / np.maximum(expected, 1e-12), 1.0))
    return np.flatnonzero(g >= G_LEAST)


def fit(rows: list[np.ndarray], labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each n-gram, intercept) from presence sets, 0/1 labels, and in how many toxic and clean rows each n-gram is."""
    weights = np.zeros(len(p))
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    if not toxic or not clean:
        share = toxic / len(labels) if len(labels) else 0.0
        return weights, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    chosen = choose(p, q, toxic, clean)
    ratio = np.log((p[chosen] + SMOOTH) / (toxic + 2 * SMOOTH)) - np.log((q[chosen] + SMOOTH) / (clean + 2 * SMOOTH))
    place = np.full(len(p), -1)
    place[chosen] = np.arange(len(chosen))
    columns = [place[x][place[x] >= 0] for x in rows]
    column, row = np.concatenate(columns), np.repeat(np.arange(len(rows)), [len(x) for x in columns])
    value = ratio[column]
    fitted, intercept = _logistic(row, column, value, labels, len(chosen))
    weights[chosen] = fitted * ratio
    return weights, intercept


def _logistic(row, column, value, labels, width: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps with backtracking; the intercept is free."""
    x, b = np.zeros(width), 0.0
    n = len(labels)
    target = labels.astype(float)

    def loss(w, c):
        z = np.bincount(row, value * w[column], minlength=n) + c
        return float(np.logaddexp(0, z).sum() - (target * z).sum() + 0.5 * PENALTY * (w @ w)), z

    y, c, t, step = x.copy(), b, 1.0, 1e-3
    for _ in range(rounds):
        here, z = loss(y, c)
        error = 1 / (1 + np.exp(-z)) - target
        gw, gb = np.bincount(column, value * error[row], minlength=width) + PENALTY * y, float(error.sum())
        while True:
            nx, nb = y - step * gw, c - step * gb
            if loss(nx, nb)[0] <= here - 0.5 * step * (gw @ gw + gb * gb) + 1e-12 or step < 1e-12:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, c = nx + (t - 1) / t2 * (nx - x), nb + (t - 1) / t2 * (nb - b)
        done = np.abs(nx - x).max(initial=abs(nb - b)) < 1e-7
        x, b, t, step = nx, nb, t2, step * 1.3
        if done:
            break
    return x, b


def prior_shift(toxic: int, clean: int, sample_per_class: int) -> float:
    """What the log odds of a fit on at most ``sample_per_class`` rows of each class lack to the odds among all labels."""
    if not toxic or not clean:
        return 0.0
    return float(np.log(toxic / min(toxic, sample_per_class)) - np.log(clean / min(clean, sample_per_class)))


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on the labelled documents outside the held-out fold."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).filter(~held_out(DIVISOR, HELD_OUT))
    order = F.xxhash64("doc_id", F.lit(7))
    # At most 2 * sample_per_class ids, whatever the number of labels; how many there are of each class is counted over all.
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (1, 0):
        some = marked.filter(F.col("label") == label).orderBy(order, "doc_id").limit(sample_per_class)
        picked = some if picked is None else picked.unionByName(some)
    once = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    sample = once.select(F.xxhash64("doc_id").alias("row"), "text", F.col("label").cast("int").alias("label"))
    found = stored(sample.mapInArrow(_features, "row long, label int, features binary, sketch array<long>"))
    sketched = sorted(found.select("row", "label", "sketch").collect(), key=lambda r: (r["label"], r["row"]))
    kept = {r["row"] for r in without_copies(sketched)}
    kept_rows = found.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in sorted(kept)], "row long")), "row")
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in kept_rows.select("label", "features").mapInArrow(_counts(BITS), "piece int, counts binary").groupBy("piece").applyInPandas(_add_counts, "piece int, counts binary").collect():
        size = (1 << BITS) // PIECES
        own = slice(r["piece"] * size, (r["piece"] + 1) * size)
        q[own], p[own] = np.frombuffer(r["counts"], np.int32).reshape(2, size)
    n = {label: sum(r["label"] == label and r["row"] in kept for r in sketched) for label in (0, 1)}
    wanted = np.zeros(1 << BITS, bool)
    if n[0] and n[1]:
        wanted[choose(p, q, n[1], n[0])] = True

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int32) for x in batch["features"]]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["label"], pa.array([x[wanted[x]].tobytes() for x in own], pa.binary())], ["row", "label", "features"])

    rows = sorted(kept_rows.select("row", "label", "features").mapInArrow(few, "row long, label int, features binary").collect(), key=lambda r: (r["label"], r["row"]))
    discard(found)
    weights, intercept = fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["label"] for r in rows], dtype=int), p, q)
    return weights, intercept + prior_shift(sizes.get(1, 0), sizes.get(0, 0), sample_per_class)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to all columns of ``docs`` (which needs ``text``)."""
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], intercept))  # 2**18 pairs at most

    def run(batches):
        numbers, values, start = shared.value
        dense = np.zeros(1 << BITS)
        dense[numbers] = values
        wanted = dense != 0
        for batch in batches:
            for a, b in chunks(batch["text"], TEXT_BYTES):
                part = batch.slice(a, b - a)
                z = np.fromiter((dense[x].sum() for x in presence(part["text"], SIZES, wanted=wanted)), dtype=float, count=b - a) + start
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights, intercept = train(docs, labels)
    base = docs.select("doc_id", "text", held_out(DIVISOR, HELD_OUT).alias("held_out"))
    return score(base, weights, intercept).drop("text")
