"""Helpers shared by the text operators: words, hashes, checkpoints.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}. All hashing is
64-bit and deterministic, so reruns and retried tasks agree.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a private one only where all runs in one process and none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="fringelake-checkpoint-")
        context.setCheckpointDir(folder)


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and read it from there on, partition by partition."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Shuffle files of an execution can go when it ends, for its result is a table on the shared folder.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``frame`` as a table in the shared checkpoint folder and read it from there on.

    For loops: a table has its true size, while a checkpoint keeps the planner's
    estimate, which multiplies with every join. ``by`` names a column of few values whose
    rows are read apart. ``discard`` deletes the table.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for frame in frames:
        spark, path = frame.sparkSession, frame.stored_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(*columns: str):
    """Key of a row by its content: equal rows share it, and get equal results."""
    return F.xxhash64(*columns)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; one long text is one range."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, words by code, offsets of each text's words). Null texts have no words.

    ``lower`` lower-cases A-Z; several codes may then stand for one word.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    ends = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    codes = np.asarray(encoded.indices)
    values = encoded.dictionary
    offsets = np.concatenate([[0], np.cumsum(ends)])
    blank = pc.index(values, pa.scalar("", values.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, pc.ascii_lower(values) if lower else values, offsets


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in values.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(values))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of each text's words)."""
    codes, values, offsets = split_words(texts, lower)
    return hash_values(values)[codes] if len(values) else np.zeros(0, np.uint64), offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` words, finalised; runs across texts must be masked by the caller."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out *= BASE
        out += words[i : i + count]
    return mix(out)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE)]).astype(np.uint64))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE_INVERSE)]).astype(np.uint64))
    return up, down


def span_hasher(words: np.ndarray):
    """f(starts, ends): hash of each span of words, whatever its length, from prefix sums."""
    size = 1 << max(10, len(words).bit_length())
    up, down = _powers(size)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return spans


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)
