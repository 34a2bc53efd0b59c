"""Exact duplicates: frequent digests are settled map-side, only the others are shuffled.

1. Each text is read once; its SHA-256 after lower-casing A-Z, its id and a row
   number are written as a narrow table to the shared folder. The number is fixed
   by that write, so retried tasks see the same one.
2. Misra-Gries: Spark's frequent-items aggregate keeps ``counters`` counters a task
   and merges them. A digest of more than ``rows / (counters + 1)`` rows cannot be
   missing from the candidates; others may be among them.
3. Verification: the candidates' exact counts and winners, by one aggregation with
   map-side sums. Those frequent enough are at most ``counters`` rows, whatever the
   input, so they are broadcast; their rows get their answer where they are read.
4. All other digests have groups of at most ``rows / counters`` rows, which go
   through one ordinary shuffle.

Only DataFrame functions are used.

Cases: a null text counts as the empty text; a null id loses to every other id,
``keep_id`` is null if all ids of a group are null; of rows that share both text and
largest id exactly one is kept; an empty table gives no rows; extra columns
are left out, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Counters of the Misra-Gries summary, and so the most digests that are broadcast: 4,096 rows of about 100 bytes.
COUNTERS = 4096


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # In a text of ASCII characters only, the general function changes no others, and is faster.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) and rid of every row, as a stored table."""
    return stored(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("rid")))


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, n, best (doc_id and rid of the row that stays) of all digests that more than one of ``counters`` rows has, as a stored table."""
    found = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], 1 / counters)
    candidates = found.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))
    exact = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("best"))
    return stored(exact.filter(F.col("n") * counters >= rows.count()))


def mark_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = digests(docs)
    heavy = F.broadcast(frequent_digests(rows, counters))
    group = Window.partitionBy("digest")
    light = rows.join(heavy, "digest", "left_anti").select("*", F.count(F.lit(1)).over(group).alias("n"), F.max(F.struct("doc_id", "rid")).over(group).alias("best"))
    both = rows.join(heavy, "digest").select(*light.columns).unionByName(light)
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
