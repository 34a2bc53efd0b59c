"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are whole numbers (``floor(scale * x)``). Rows are laid out in blocks: ranges of
a locality order (the leading dimensions and their signs). A block is one row that holds
its forward index (all vectors) and, for every term (dimension), the largest and the
least value. The sum over terms of the larger of ``q * max`` and ``q * min`` bounds every
score of the block. Queries meet blocks in waves by falling bound: each wave takes the
next blocks of a query's order, as far as their bound still reaches the k-th best score
found so far, which rises from wave to wave; a wave that no block reaches ends the
search. Bounds come from portions of at most ``SUMMARY_BLOCKS`` block summaries; the
order by bound is that within a portion.

Of a query chunk and a block that meet, the smaller side is sent to the other: some
queries to the block, or the block to the chunk. Where bounds prune nothing, all blocks
go to all chunks, ``vectors * queries / QUERY_ROWS`` vectors in all.

Cases: vectors that are null, empty, or hold null or non-finite components take no part;
vectors of different lengths score over their common length; components are held to
+-2**62 and scores to 64 bits; equal ids are separate rows, and only a query's own row is
no candidate for it; ties go to the smaller id; null ids take no part; without queries or
candidates there are no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

K = 5
SCALE = 256.0
BLOCK_ROWS = 1024
QUERY_ROWS = 2048
SUMMARY_BLOCKS = 2048
#: How many blocks more a wave goes down a query's order than the wave before.
GROWTH = 8
#: Leading dimensions of the locality order.
LEADING = 4
#: Summaries of so many bytes at most are broadcast; beyond, chunks are joined with them by shuffle.
BROADCAST_BYTES = 32 << 20
LARGEST = 1 << 62
SCHEMA = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, is_query, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<long>, asked) of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them; the length tells which it is."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def _matrix(data: bytes, width: int, count: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (width * count)]).reshape(count, width).astype(np.int64)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer products, held to 64 bits; in doubles (BLAS) where these are exact, in long integers where 64 bits are not."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q.astype(float) @ d.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return q @ d.T
    return np.clip(q.astype(object) @ d.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of each query's k best rows: higher score, then smaller id; ``own`` is the query's row."""
    order = np.argsort(ids, kind="stable")
    scores, rows = scores[:, order], rows[order]
    n = len(ids)
    free = rows[None, :] != own[:, None]
    if np.abs(scores).max(initial=0) < 2**50 // n:
        key = np.where(free, scores * n + np.arange(n - 1, -1, -1), -(2**62))
        top = np.argpartition(key, max(0, n - k), axis=1)[:, max(0, n - k) :]
        at = np.repeat(np.arange(len(own)), top.shape[1])
        to = top.ravel()
        keep = free[at, to]
        return at[keep], order[to[keep]]
    at, to = [], []
    for i, row in enumerate(scores):
        take = np.flatnonzero(free[i])
        take = take[sorted(range(len(take)), key=lambda j: -int(row[take[j]]))][:k]  # noqa: B023
        at += [i] * len(take)
        to += order[take].tolist()
    return np.array(at, np.int64), np.array(to, np.int64)


def pack_blocks(rows: DataFrame, per: int, width: int) -> DataFrame:
    """(block, n, rows, ids, v, most, least): runs of ``per`` rows at most of the locality order, one row each."""
    size = F.array_sort(F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("a"), (i * 2 + F.when(x < 0, 1).otherwise(0)).alias("b"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("lead", F.transform(F.slice(size, 1, LEADING), lambda x: x["b"])).repartitionByRange(parts, "lead", "row").sortWithinPartitions("lead", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, ids, numbers = np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(count: int) -> pa.RecordBatch:
            v = held[:count]
            values = [[number], [count], [numbers[:count].tobytes()], [ids[:count].tobytes()], [_narrow(v)], [v.max(axis=0).tobytes()], [v.min(axis=0).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, [pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True)], ["block", "n", "rows", "ids", "v", "most", "least"])

        for batch in batches:
            lengths = np.asarray(batch["v"].value_lengths(), np.int64)
            v = np.zeros((len(batch), width), np.int64)
            v[np.arange(width)[None, :] < lengths[:, None]] = batch["v"].flatten().to_numpy(zero_copy_only=False)
            held = np.concatenate([held, v])
            ids, numbers = np.concatenate([ids, batch["vec_id"].to_numpy()]), np.concatenate([numbers, batch["row"].to_numpy()])
            while len(held) >= per:
                yield out(per)
                held, ids, numbers, number = held[per:], ids[per:], numbers[per:], number + 1
        if len(held):
            yield out(len(held))

    return placed.select("row", "vec_id", "v").mapInArrow(run, "block long, n long, rows binary, ids binary, v binary, most binary, least binary")


def _portion(key, rows):
    rows = rows.sort_values("block")
    return rows.iloc[:1][["portion"]].assign(**{x: [b"".join(rows[x])] for x in ("most", "least")}, blocks=[rows["block"].to_numpy(np.int64).tobytes()], sizes=[rows["n"].to_numpy(np.int64).tobytes()])[["portion", "blocks", "sizes", "most", "least"]]


def _choose(width: int, low: int, high: int):
    """Which blocks of places ``low`` to ``high`` in the falling order of bounds each query of a chunk has to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _matrix(r["v"], width, r["n"])
                blocks, sizes = (np.frombuffer(r[x], np.int64) for x in ("blocks", "sizes"))
                most, least = (np.frombuffer(r[x], np.int64).reshape(-1, width) for x in ("most", "least"))
                bound = products(np.maximum(q, 0), most) + products(np.minimum(q, 0), least) if np.abs(most).max(initial=0) < 2**30 else products(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1), np.concatenate([most, least], axis=1))
                open_ = np.ones(len(q), bool)
                floor = np.zeros(len(q), np.int64)
                for f in r["floors"] or ():
                    open_[f["place"]], floor[f["place"]] = False, f["floor"]
                place = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                meet = open_[:, None] | (np.take_along_axis(bound, place, axis=1) >= floor[:, None])
                who, to = np.nonzero(meet)[0], place[meet]
                order = np.argsort(to, kind="stable")
                who, to = who[order], to[order]
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                out = {x: [] for x in ("block", "chunk", "met", "n", "who", "asked", "asked_rows", "q")}
                for own in np.split(who, np.flatnonzero(np.diff(to)) + 1) if len(who) else ():
                    j = int(to[len(out["met"]) and sum(out["met"])])
                    send = len(own) <= sizes[j]
                    for x, value in zip(out, (int(blocks[j]), r["block"], len(own), r["n"], own.astype(np.int32).tobytes(), ids[own].tobytes(), rows[own].tobytes(), _narrow(q[own]) if send else None), strict=True):
                        out[x].append(value)
                types = [pa.int64()] * 4 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    return run


def _meet(width: int, k: int):
    """Score queries against a block's forward index: the k best rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                who = np.frombuffer(r["who"], np.int32)
                q = _matrix(r["q"], width, r["met"]) if r["q"] is not None else _matrix(r["chunk_v"], width, r["n"])[who]
                ids = np.frombuffer(r["ids"], np.int64)
                score = products(q, _matrix(r["v"], width, len(ids)))
                at, to = best(score, np.frombuffer(r["asked_rows"], np.int64), np.frombuffer(r["rows"], np.int64), ids, k)
                columns = [np.full(len(at), r["chunk"], np.int64), who[at], np.frombuffer(r["asked"], np.int64)[at], ids[to], score[at, to]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["chunk", "place", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, growth: int = GROWTH, stats: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which ``is_query`` holds, against all others.

    ``stats`` receives the number of (query, block) pairs met in each wave, and then that of all such pairs.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, is_query, scale).withColumn("row", F.monotonically_increasing_id()))
    count, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("v"))).first()
    if not asked or count < 2:
        return spark.createDataFrame([], SCHEMA)
    blocks = stored(pack_blocks(rows, block_rows, width))
    chunks = stored(pack_blocks(rows.filter("asked"), query_rows, width).drop("most", "least"))
    n_blocks = blocks.count()
    parts = -(-n_blocks // SUMMARY_BLOCKS)
    summaries = blocks.select("block", "n", "most", "least", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("portion"))
    portions = stored(summaries.groupBy("portion").applyInPandas(_portion, "portion int, blocks binary, sizes binary, most binary, least binary"))
    # One row a portion; two numbers of 8 bytes a dimension of each block.
    faced_side = F.broadcast(portions) if 16 * width * n_blocks <= BROADCAST_BYTES else portions
    deepest = portions.agg(F.max(F.octet_length("blocks") / 8)).first()[0]
    ranked = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), "vec_id")
    found, low, high = None, 0, 1
    while low < deepest:
        if found is None:
            floors = chunks.select("block").withColumn("floors", F.lit(None).cast("array<struct<place:int,floor:long>>")).limit(0)
        else:
            kth = found.groupBy("chunk", "place").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            floors = kth.groupBy(F.col("chunk").alias("block")).agg(F.collect_list(F.struct("place", "floor")).alias("floors"))  # query_rows at most
        faced = chunks.join(floors, "block", "left").withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(faced_side, "portion")
        pairs = stored(faced.drop("portion").mapInArrow(_choose(width, low, high), "block long, chunk long, met long, n long, who binary, asked binary, asked_rows binary, q binary"))
        met = pairs.agg(F.sum("met")).first()[0]
        if stats is not None:
            stats.append(met or 0)
        if not met:
            discard(pairs)
            break
        index = blocks.select("block", "rows", "ids", "v")
        few = pairs.filter(F.col("q").isNotNull()).join(index, "block").withColumn("chunk_v", F.lit(None).cast("binary"))
        many = pairs.filter(F.col("q").isNull()).join(index, "block").join(chunks.select(F.col("block").alias("chunk"), F.col("v").alias("chunk_v")), "chunk")
        columns = ["chunk", "met", "n", "who", "asked", "asked_rows", "q", "rows", "ids", "v", "chunk_v"]
        new = few.select(*columns).unionByName(many.select(*columns)).mapInArrow(_meet(width, k), "chunk long, place int, query_id long, vec_id long, score long")
        merged = (new if found is None else found.unionByName(new)).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        before, found = found, stored(merged.drop("rank"))
        discard(pairs, *([before] if before is not None else []))
        low, high = high, high * growth
    discard(rows, blocks, chunks, portions)
    if stats is not None:
        stats.append(asked * n_blocks)
    return found.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")
