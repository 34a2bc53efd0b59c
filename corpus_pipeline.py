"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixture.

Each stage takes and returns the columns of ``documents`` (the last returns the
mixture); extra columns are left out, null and empty texts are kept by every
stage but where its operator says otherwise. Stages decide by row, so documents
with one id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.llm import decontaminate, jaccard, mixing, repeats, toxicity
from fringelake.llm.common import discard, row_key, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many row keys (8 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_KEYS = 1_000_000
SHINGLE, PERCENT = 5, 80
#: Rows of a batch that goes between Spark and a Python worker: texts are long, and every stage shares its memory with those before it.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, in batches of ``BATCH_ROWS`` rows at most."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``keys``."""
    keys = stored(keys.distinct())
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    gone = keys.select(F.col("key").alias("_key"))
    return keyed.join(F.broadcast(gone) if keys.count() <= BROADCAST_KEYS else gone, "_key", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    docs = _columns(docs)
    weights, intercept = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, intercept).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id stays; texts without words are no group."""
    docs = _columns(docs)
    found = stored(jaccard.jaccard_components(docs, SHINGLE, PERCENT).filter("n_shingles > 0"))
    # Stored, so that the join with a hot component can be split.
    best = stored(found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")).select("comp", F.col("best.key").alias("stays")))
    kept = _without(docs, found.join(best, "comp").filter("key <> stays").select("key"))
    same = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    if same.isEmpty():
        return kept
    # Equal rows share a key: one of them stays.
    once = kept.withColumn("_key", row_key("doc_id", "text")).join(same.select(F.col("key").alias("_key")), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)
    return _without(kept, same).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere too are cut out of the texts."""
    found = repeats.remove_repeats(_columns(docs), keep_text=True)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _columns(docs)
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken for the mixture."""
    return mixing.mix_sources(_columns(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix),
]
#: The classifier and the sampling have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. The session's batch setting is as before."""
    docs, before, batch = table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
            if before is not None:
                discard(before)
            before = docs
    finally:
        spark.conf.set(BATCH_SETTING, batch)
    return docs
