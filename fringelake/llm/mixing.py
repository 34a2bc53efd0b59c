"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a share of the mixture's words. A document of a source with
ratio ``r`` (target over size) is taken floor(r) times for sure and once more
with inclusion probability r - floor(r). Which documents are taken once more is
decided by the cube method: the probabilities of a block move along the null
space of the balancing constraints (words and documents) until at most two per
block are undecided; those meet the undecided of other blocks, level by level.
The last ones of each source, with up to ``RESERVE`` documents kept out of the last flight, are
landed on the outcome nearest its target: these few (2 + ``RESERVE`` a source at most) are taken
for the total's sake and not by a draw, all others with exactly their inclusion probability.

Cases: null texts have size 0; null sources are one source, last in order;
sources whose size is 0 have target 0; equal rows are separate documents;
empty tables give empty results. Extra columns are left out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 512
#: Documents of each source that meet the landing problem besides those left by the flight.
RESERVE = 10
#: Up to so many sources (at most 64 bytes a row besides the name) the source table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) for each source of ``sizes`` (source, size).

    Targets solve sum(min(most * size, level * weight)) = share * total, which
    is what repeated resharing of the excess by weight arrives at.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # Rank in code-point order without a one-task window: range partitions, then offsets.
    ranged = cut(totals.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()))
    placed = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    offsets, seen = {}, 0
    for part in sorted(counts):
        offsets[part] = seen
        seen += counts[part]
    if offsets:
        start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
        rank = F.col("_in") + start[F.col("_part")]
    else:
        rank = F.col("_in")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.select("source", "source_size", "n_docs", F.get(weight, F.pmod(rank, F.lit(len(weights))).cast("int")).alias("weight"))
    limit = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = None
    while True:  # each round caps at least one more source, and there are few rounds
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        capped, free, n_free = weighed.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count(F.when(~above, True))).first()
        if not n_free or not free:
            break
        now = (total - (capped or 0.0)) / free
        if level is not None and now <= level:
            break
        level = now
    target = F.least(limit, F.col("weight") * F.lit(level)) if level is not None else limit
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` through the null space of (sum, size-weighted sum) until two at most are fractional.

    Units are met in the given order; three undecided ones are held at a time,
    and the direction keeps both totals. Sizes may be equal or zero.
    """
    out = pi.astype(float).copy()
    draws = rng.random(len(out) + 3).tolist()
    values, sizes = out.tolist(), size.astype(float).tolist()
    held: list[int] = []
    eps = 1e-9
    step = 0
    for i in range(len(values)):
        if values[i] <= eps or values[i] >= 1 - eps:
            values[i] = float(round(values[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # The cross product of (1, 1, 1) and the sizes keeps both sums.
        direction = [sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]]
        if not any(direction):
            direction = [1.0, -1.0, 0.0]
        up = min((1 - values[k]) / d if d > 0 else values[k] / -d for k, d in zip(held, direction, strict=True) if d)
        down = min(values[k] / d if d > 0 else (1 - values[k]) / -d for k, d in zip(held, direction, strict=True) if d)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for k, d in zip(held, direction, strict=True):
            values[k] = min(1.0, max(0.0, values[k] + move * d))
            if values[k] <= eps or values[k] >= 1 - eps:
                values[k] = float(round(values[k]))
        held = [k for k in held if eps < values[k] < 1 - eps]
    return np.asarray(values)


def landing(size: np.ndarray, pi: np.ndarray, words: float, docs: float) -> np.ndarray:
    """Round the undecided (2 + RESERVE at most) to the outcome nearest ``words`` and then ``docs``."""
    out = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    outcomes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off_words, off_docs = np.abs(outcomes @ size[open_] - words), np.abs(outcomes.sum(axis=1) - docs)
    out[open_] = outcomes[np.lexsort((off_docs, off_words))[0]]
    return out


def _fly(seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Larger documents first, so that what stays open is small.
        rows = rows.sort_values(["size", "_row"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(key[0]) & 0x7FFFFFFF, int(key[1]) & 0x7FFFFFFF])
        size, pi = rows["size"].to_numpy(np.float64), rows["_pi"].to_numpy(np.float64)
        if not last:
            rows["_pi"] = flight(size, pi, rng)
            return rows
        # The landing problem: what the flight leaves open, and a few documents of different sizes kept out of it.
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        kept = open_[np.unique(np.linspace(0, len(open_) - 1, min(RESERVE, len(open_))).astype(int))] if len(open_) else open_
        flown = pi.copy()
        flown[kept] = 0.0
        flown = flight(size, flown, rng)
        flown[kept] = pi[kept]
        left = (flown > 0) & (flown < 1)
        rows["_pi"] = landing(size, flown, float((size * flown)[left].sum()), float(flown[left].sum()))
        return rows

    return run


def mix_sources(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= size * copies)."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    # Equal rows are numbered, so that they are dealt to different blocks.
    same = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = cut(same.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_same")))
    targets = cut(source_targets(sized, weights, share, most).withColumn("_source", F.monotonically_increasing_id()))
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    small = targets.withColumnRenamed("source", "_name")
    joined = sized.join(F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = joined.select(
        "doc_id", "source", "size", "source_size", "target", "_source", F.floor(ratio).alias("_sure"), (ratio - F.floor(ratio)).alias("_pi"),
        F.ceil(F.col("n_docs") / block_rows).alias("_blocks"), F.xxhash64("doc_id", "size", "_same", F.lit(seed)).alias("_row"),
    )
    units = units.withColumn("_block", F.pmod("_row", "_blocks"))
    blocks = math.ceil((largest or 1) / block_rows)
    done = None
    while True:
        last = blocks <= 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
        flown = units.groupBy("_source", "_block").applyInPandas(_fly(seed, last), schema)
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        flown = cut(flown)
        fractional = (F.col("_pi") > 0) & (F.col("_pi") < 1)
        decided = flown.filter(~fractional)
        done = decided if done is None else done.unionByName(decided)
        fan = max(2, block_rows // 2)  # two of each block at most are left
        blocks = math.ceil(blocks / fan)
        units = flown.filter(fractional).withColumn("_block", F.floor(F.col("_block") / fan))
    copies = (F.col("_sure") + F.round("_pi")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
