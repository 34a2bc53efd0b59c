"""A hierarchical Pitman-Yor language model over words.

Every distinct word is a context with a restaurant of its own (the words that follow it),
as is the start of a text. Their common parent is the unigram restaurant, whose base is
uniform over the known words and one unknown. The tables of a bigram are the
customers of its last word in the unigram restaurant.

Seating is sampled by Gibbs: in a round, all customers of a dish leave its restaurant
and are seated anew given the tables of the other dishes and the parent's probabilities of
the round before, which lets all dishes be sampled in parallel. What the model needs of a
seating is the number of tables, and up to ``EXACT`` customers it is drawn from its
exact distribution (generalised Stirling numbers). Beyond, customers are seated one after
another by the Chinese-restaurant rule, from ``SINGLY`` customers on in chunks of ``GROW`` of those
seated, with Metropolis-Hastings acceptance between ``SWEEPS`` seatings. After ``BURN`` rounds
each round is a sample, and the predictive probabilities of the samples are averaged.

Layout: a text block (``BLOCK_BYTES`` of whole texts) holds its words once and its texts as
numbers of words. Bigrams live in buckets, by ranges of the last word's hash. Each block asks each
bucket for its distinct bigrams, once, with their counts; everything later refers to places in
that request. A bucket adds the counts up and holds the words' part of the unigram
restaurant. The tables of a context are added up in the bucket of the context's own hash and
told to the buckets that asked. A word of more than half a bucket is dealt to all buckets by
its context, and its customers are added up by the driver (two such words a bucket at most). At last
each block gets the answers to its request and scores its texts.

Cases: null and empty texts are one end token; equal rows are counted and scored
each; null ids hash as the empty text; without training rows every token has probability
1; one long text is a block; extra columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, discard, hash_values, mix, split_words, stored
from .toxicity import held_out

BLOCK_BYTES = 4 << 20
#: About so many tokens are a bucket; a small corpus has up to ``LEAST_BUCKETS`` smaller ones.
BUCKET_TOKENS, SMALL_BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 250_000, 8
ROUNDS, BURN = 4, 1
EXACT = 64
#: Entries of a table of weights that is drawn from at a time.
PLACES = 500_000
SWEEPS, SINGLY, GROW = 4, 64, 0.05
STRENGTH = 1.0
DIVISOR, HELD_OUT = 10, 0
#: The end token and the context of a text's first word; no word contains white space.
END, START = "\n", "\n\n"
KINDS = "kind int, bucket int, other long, data binary"
STATIC, ASKED, VALUES, TOTAL, HOME, LISTENERS, WORDS, TABLES, CONTEXT = range(9)
# Numbers that the driver adds up over buckets; hot words follow, two numbers each.
DISTINCT, TOKENS, ONES, TWOS, TOP_ONES, TOP_TWOS, CUSTOMERS, TOP_TABLES, FIRST_HOT = range(9)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of the narrowest type; uint64 are rising hashes, of which differences are kept."""
    out = []
    for x in arrays:
        rising = x.dtype == np.uint64
        y = np.diff(x, prepend=np.uint64(0)) if rising else x
        most = int(y.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        planes = y.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True)
        out.append(struct.pack("<qqBB", len(x), len(small), width, rising) + small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size, width, rising = struct.unpack_from("<qqBB", data, at)
        at += 18
        planes = pa.decompress(data[at : at + size], decompressed_size=n * width, codec="zstd", asbytes=True)
        at += size
        y = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()
        out.append(np.cumsum(y.astype(np.uint64), dtype=np.uint64) if rising else y.astype(np.int64))
    return out


# --- text blocks and what they ask for


@lru_cache(maxsize=1)
def _marks() -> tuple[np.uint64, np.uint64]:
    return tuple(hash_values(pa.array([END, START])))


def read_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, distinct words with the start, place of each token's word); every text ends with the end token."""
    codes, values, offsets = split_words(texts, lower=True)
    hashes = hash_values(values) if len(values) else np.zeros(0, np.uint64)
    words, place = np.unique(np.concatenate([hashes, np.array(_marks(), np.uint64)]), return_inverse=True)
    counts = np.diff(offsets)
    tokens = np.full(len(codes) + len(counts), place[-2], np.int64)
    tokens[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = place[codes]
    used = np.zeros(len(words), bool)
    used[tokens] = used[place[-1]] = True
    return counts + 1, words[used], (np.cumsum(used) - 1)[tokens]


def _blocks(kind, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths, words, tokens = read_texts(rows["text"])
            own = [pa.array([number], pa.int64()), pa.array([rows["doc_id"].to_pylist()], pa.list_(kind)), pa.array([rows["held_out"].to_pylist()], pa.list_(pa.bool_())), pa.array([len(tokens)], pa.int64()), pa.array([pack(lengths, words, tokens)], pa.binary())]
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(own, ["block", "doc_id", "held_out", "n", "texts"])

        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0), np.int64) + 1)
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                if held and ends[start] - before + size > block_bytes:  # the next text opens a block
                    yield out()
                    held, size, number = [], 0, number + 1
                    continue
                held.append(pa.RecordBatch.from_arrays([x.take(pa.array(range(start, stop))) for x in batch.columns], batch.schema.names))  # a copy, for slices hold on to the whole batch
                size += int(ends[stop - 1] - before)
                start = stop
        if held:
            yield out()

    return run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that rising hashes have rising buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Request:
    """The distinct bigrams of a block, and the parts of them that each bucket answers."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, tokens: np.ndarray, buckets: int, hot: np.ndarray):
        self.words, self.tokens, self.lengths = words, tokens, lengths
        self.starts = np.cumsum(lengths) - lengths
        context = np.concatenate([[0], tokens[:-1]])
        context[self.starts] = np.searchsorted(words, _marks()[1])
        pairs, self.pair = np.unique(tokens * len(words) + context, return_inverse=True)
        self.word, self.context = np.divmod(pairs, len(words))
        self.home = bucket_of(words, buckets)
        to = self.home[self.word]
        if len(hot):
            spread = np.flatnonzero(np.isin(words, hot)[self.word])
            to[spread] = bucket_of(mix(words[self.word[spread]] * BASE + words[self.context[spread]]), buckets)
        self.order = np.argsort(to, kind="stable")
        self.cuts = np.searchsorted(to[self.order], np.arange(buckets + 1))
        self.homes = np.searchsorted(self.home, np.arange(buckets + 1))

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, words) that bucket ``k`` is asked for, both rising; words of its own range are asked for as contexts too."""
        pairs = self.order[self.cuts[k] : self.cuts[k + 1]]
        return pairs, np.union1d(self.word[pairs], np.arange(self.homes[k], self.homes[k + 1]))


def _requests(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, words, tokens = unpack(r["texts"])
                ask = Request(lengths, words, tokens, buckets, hot)
                learn = np.repeat(~np.array(r["held_out"], bool), lengths)
                n = np.bincount(ask.pair[learn], minlength=len(ask.word))
                to, data = [], []
                for k in range(buckets):
                    pairs, own = ask.part(k)
                    if len(own):
                        contexts = np.unique(ask.context[pairs])
                        each = np.bincount(np.searchsorted(own, ask.word[pairs]), minlength=len(own))
                        to.append(k)
                        data.append(pack(words[own], words[contexts], each, np.searchsorted(contexts, ask.context[pairs]), n[pairs]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([r["block"]] * len(to), pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])

    return run


def _heavy(share: float):
    """Words that are more than ``share`` of a block's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["texts"]:
                _, words, tokens = unpack(data.as_py())
                n = np.bincount(tokens, minlength=len(words))
                heavy = np.flatnonzero(n > share * len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(words[heavy].view(np.int64)), pa.array(n[heavy])], ["w", "n"])

    return run


# --- seating


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: [n, t] is that of the weights of seating n customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for n in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf) + out[n, 1:])
    return out


def seat(customers: np.ndarray, open_weight: np.ndarray, gain: np.ndarray, discount: float, rng: np.random.Generator, singly: int = SINGLY, grow: float = GROW) -> tuple[np.ndarray, np.ndarray]:
    """Seat the customers of each dish one after another: (tables, log importance weight).

    A new table has weight ``open_weight + gain * (tables - 1)``, the occupied ones together the
    customers seated less ``discount`` for each table.
    """
    tables, logw = np.minimum(customers, 1).astype(float), np.zeros(len(customers))
    seated = tables.copy()
    active = np.flatnonzero(customers > 1)
    step = 0
    while len(active):
        step += 1
        i, t = seated[active], tables[active]
        chunk = np.ones(len(active)) if step < singly else np.minimum(np.maximum(1, np.floor(i * grow)), customers[active] - i)
        new = open_weight[active] + gain[active] * (t - 1)
        mass = new + np.maximum(i - discount * t, 1e-9)
        p = np.clip(new / mass, 0, 1)
        fresh = rng.binomial(chunk.astype(np.int64), p) if step >= singly else (rng.random(len(active)) < p)
        logw[active] += chunk * np.log(mass)
        tables[active] += fresh
        seated[active] += chunk
        active = active[seated[active] < customers[active]]
    return tables, logw


def draw(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """The number of tables of each dish, given the parent's probability of it and the tables of the restaurant's other dishes."""
    out = np.minimum(customers, 1).astype(np.int64)
    numbers = log_stirling(discount, exact)
    order = np.argsort(customers, kind="stable")
    cuts = np.searchsorted(customers[order], np.arange(2, exact + 2))
    for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), start=2):
        for start in range(a, b, 1 + PLACES // n):
            own = order[start : min(b, start + 1 + PLACES // n)]
            t = np.arange(n)
            weight = np.cumsum(np.log(STRENGTH + discount * (others[own, None] + t)), axis=1) + np.log(parent[own, None]) * (t + 1) + numbers[n, 1 : n + 1]
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (total < rng.random(len(own))[:, None] * total[:, -1:]).sum(axis=1)
    many = order[cuts[-1] :]
    if len(many):
        n, p, o = customers[many].astype(float), parent[many], others[many]
        tables, weight = seat(n, (STRENGTH + discount * (o + 1)) * p, discount * p, discount, rng)
        for _ in range(SWEEPS - 1):
            new, w = seat(n, (STRENGTH + discount * (o + 1)) * p, discount * p, discount, rng)
            take = np.log(rng.random(len(n))) < w - weight
            tables, weight = np.where(take, new, tables), np.where(take, w, weight)
        out[many] = tables.astype(np.int64)
    return out


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


# --- buckets


def _rows(rows: list[tuple[int, int, int, bytes | None]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "other", "data"])


def _add(total: dict[int, int]) -> list[tuple]:
    """Numbers for the driver to add up, the number's name in the place of the bucket."""
    return [(TOTAL, name, int(n), None) for name, n in total.items() if n]


def _sum(where: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(where, n, minlength=size).astype(np.int64)


def _count(buckets: int, hot: np.ndarray):
    """Add up the requests to a bucket. Of bigrams seen twice or more ("live") seatings are sampled, others have one table."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        asked = [unpack(x) for x in rows["data"]]
        words, contexts = np.unique(np.concatenate([x[0] for x in asked])), np.unique(np.concatenate([x[1] for x in asked]))
        at = [np.searchsorted(words, x[0]) for x in asked]
        pairs = np.concatenate([np.repeat(w, x[2]) * len(contexts) + np.searchsorted(contexts, x[1])[x[3]] for w, x in zip(at, asked, strict=True)])
        pairs, where = np.unique(pairs, return_inverse=True)
        n = _sum(where, np.concatenate([x[4] for x in asked]), len(pairs))
        word, context = np.divmod(pairs, len(contexts)) if len(contexts) else (pairs, pairs)
        one, live = n == 1, n > 1
        c, single = _sum(word, n, len(words)), np.bincount(word[one], minlength=len(words))
        out, number, start = [], np.cumsum(live) - 1, 0
        for block, w, x in zip(rows["block"], at, asked, strict=True):
            own = where[start : start + len(x[4])]
            start += len(own)
            out.append((ASKED, k, block, pack(w, n[own], number[own[n[own] > 1]])))
        size = len(contexts)
        customers, singles, lively = _sum(context, n, size), np.bincount(context[one], minlength=size), np.bincount(context[live], minlength=size)
        wide = np.flatnonzero(lively)  # contexts of live bigrams
        to = bucket_of(contexts, buckets)
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        for j in np.unique(to[customers > 0]).tolist():
            some = np.arange(cuts[j], cuts[j + 1])
            some = some[customers[some] > 0]
            out.append((CONTEXT, j, k, pack(contexts[some], customers[some], singles[some], lively[some])))
        spread = np.flatnonzero(np.isin(words, hot))
        names = np.searchsorted(hot, words[spread])
        out.append((STATIC, k, 0, pack(single, np.bincount(word[live], minlength=len(words)), n[live], np.searchsorted(wide, context[live]), to[wide], spread, names)))
        out.append((WORDS, k, 0, pack(words, c)))
        first = single + np.bincount(word[live], minlength=len(words))
        cool = np.ones(len(words), bool)
        cool[spread] = False
        total = {DISTINCT: (c[cool] > 0).sum(), TOKENS: c.sum(), ONES: one.sum(), TWOS: (n == 2).sum(), TOP_ONES: (first[cool] == 1).sum(), TOP_TWOS: (first[cool] == 2).sum(), CUSTOMERS: first.sum()}
        for i, name in zip(spread.tolist(), names.tolist(), strict=True):
            total |= {FIRST_HOT + 2 * name: c[i], FIRST_HOT + 2 * name + 1: first[i]}
        return _rows(out + _add(total))

    return run


def _meet_contexts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The contexts of a bucket's own range: who listens to their tables, and what these are at first."""
    k, asked = int(key[0]), [unpack(x) for x in rows["data"]]
    contexts = np.unique(np.concatenate([x[0] for x in asked]))
    at = [np.searchsorted(contexts, x[0]) for x in asked]
    customers, singles, lively = (_sum(np.concatenate(at), np.concatenate([x[i] for x in asked]), len(contexts)) for i in (1, 2, 3))
    listens = [w[x[3] > 0] for w, x in zip(at, asked, strict=True)]
    out = [(HOME, k, 0, pack(contexts, customers)), (LISTENERS, k, 0, pack(singles, rows["other"].to_numpy(np.int64), np.array([len(x) for x in listens]), np.concatenate(listens)))]
    return _rows(out + [(VALUES, int(to), k, pack((singles + lively)[w])) for to, w in zip(rows["other"], listens, strict=True) if len(w)])


def _tell_tables(r: int):
    """Add up the tables of a bucket's contexts, and tell the listeners."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, told = int(key[0]), rows[rows["kind"] == VALUES]
        singles, listeners, counts, places = unpack(rows["data"][rows["kind"] == LISTENERS].iloc[0])
        by = dict(zip(listeners.tolist(), np.split(places, np.cumsum(counts)[:-1]), strict=True))
        tables = singles.copy()
        for source, data in zip(told["other"], told["data"], strict=True):
            np.add.at(tables, by[int(source)], unpack(data)[0])
        return _rows([(CONTEXT, k, r, pack(tables))] + [(VALUES, to, k, pack(tables[w])) for to, w in by.items() if len(w)])

    return run


def top_probability(customers, tables, s: dict):
    """Of words in the unigram restaurant of a sample ``s``."""
    return (customers - s["d1"] * tables + (STRENGTH + s["d1"] * s["tables"]) * s["base"]) / (STRENGTH + s["customers"])


def _seat_bucket(buckets: int, s: dict, r: int, seed: int):
    """Sample the live bigrams of a bucket, and its words in the unigram restaurant."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        rng = np.random.default_rng([seed, r, k])
        if not (rows["kind"] == STATIC).any():
            return _rows([])
        single, lively, n, at, to, spread, names = unpack(rows["data"][rows["kind"] == STATIC].iloc[0])
        before = rows["data"][rows["kind"] == TABLES]
        word = np.repeat(np.arange(len(single)), lively)
        t, top = unpack(before.iloc[0]) if len(before) else (np.ones(len(n), np.int64), np.minimum(single + lively, 1))
        told = rows[rows["kind"] == VALUES].sort_values("other")
        context = np.concatenate([np.zeros(0, np.int64), *[unpack(x)[0] for x in told["data"]]])
        guests = single + _sum(word, t, len(single))
        guests[spread], top[spread] = s["hot_customers"][names], s["hot_tables"][names]
        t = draw(n, top_probability(guests, top, s)[word], (context[at] - t).astype(float), s["d2"], rng)
        guests = single + _sum(word, t, len(single))
        cool = np.ones(len(single), bool)
        cool[spread] = False
        new = np.zeros(len(single), np.int64)
        new[cool] = draw(guests[cool], np.full(cool.sum(), s["base"]), (s["tables"] - top[cool]).astype(float), s["d1"], rng)
        sums = _sum(at, t, len(to))
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        out = [(TABLES, k, r, pack(t, new))] + [(VALUES, j, k, pack(sums[cuts[j] : cuts[j + 1]])) for j in np.unique(to).tolist()]
        total = {CUSTOMERS: guests.sum(), TOP_TABLES: new.sum()}
        for i, name in zip(spread.tolist(), names.tolist(), strict=True):
            total[FIRST_HOT + 2 * name + 1] = guests[i]
        return _rows(out + _add(total))

    return run


def _answer(buckets: int, samples: list[dict]):
    """(block, bucket, answer) to every request: of words their counts and unigram seatings, of contexts their customers and tables, of bigrams their counts and tables."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, by = int(key[0]), {name: own for name, own in rows.groupby("kind")}

        def get(kind: int, r: int = 0) -> list[np.ndarray] | None:
            own = by[kind][by[kind]["other"] == r] if kind in by else ()
            return unpack(own["data"].iloc[0]) if len(own) else None

        single, lively, n, _, _, spread, names = get(STATIC)
        words, c = get(WORDS)
        contexts, customers = get(HOME) or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        word = np.repeat(np.arange(len(words)), lively)
        t, guests, top, tables = np.zeros(len(n), np.int64), [], [], []
        for s in samples:
            own, seated = get(TABLES, s["round"])
            t += own
            g = single + _sum(word, own, len(words))
            g[spread], seated[spread] = s["hot_customers"][names], s["hot_tables"][names]
            guests.append(g)
            top.append(seated)
            tables.append(get(CONTEXT, s["round"])[0] if len(contexts) else contexts.astype(np.int64))
        if samples:
            c[spread] = samples[0]["hot_words"][names]
        at_home = bucket_of(words, buckets) == k
        place = np.minimum(np.searchsorted(contexts, words), max(0, len(contexts) - 1))
        known = at_home & (contexts[place] == words) if len(contexts) else np.zeros(len(words), bool)
        part = lambda x, w: np.where(known[w], x[place[w]], 0) if len(contexts) else np.zeros(len(w), np.int64)
        blocks, data = [], []
        for block, asked in zip(by[ASKED]["other"], by[ASKED]["data"], strict=True):
            w, count, live = unpack(asked)
            own = w[at_home[w]]
            blocks.append(block)
            data.append(pack(c[w], *(x[w] for x in guests), *(x[w] for x in top), part(customers, own), *(part(x, own) for x in tables), count, t[live]))
        return pd.DataFrame({"for_block": blocks, "bucket": k, "answer": data})

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _of(table: DataFrame, *kinds: int) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds)).select("kind", "bucket", "other", "data")


def _numbers(table: DataFrame) -> dict[int, int]:
    """Sums over buckets: eight numbers, and two for each hot word."""
    return {r["bucket"]: r["n"] for r in table.filter(F.col("kind") == TOTAL).groupBy("bucket").agg(F.sum("other").alias("n")).collect()}


class Model:
    """Text blocks, what they asked of the buckets, the sampled seatings of the buckets, and the samples' totals."""

    def __init__(self, docs: DataFrame, seed: int = 29, rounds: int = ROUNDS, burn: int = BURN, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS):
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        self.block_bytes, self.bucket_tokens, self.seed = block_bytes, bucket_tokens, seed
        self.tables: list[DataFrame] = []
        self._ask(docs)
        self._first()
        self._sample(rounds, burn)

    def _keep(self, frame: DataFrame, by: str | None = None) -> DataFrame:
        self.tables.append(stored(frame, by))
        return self.tables[-1]

    def _ask(self, docs: DataFrame) -> None:
        from pyspark.sql.pandas.types import to_arrow_type

        base = docs.select("doc_id", "text", held_out(DIVISOR, HELD_OUT).alias("held_out"))
        self.blocks = self._keep(base.mapInArrow(_blocks(to_arrow_type(docs.schema["doc_id"].dataType), self.block_bytes), f"block long, doc_id array<{self.kind}>, held_out array<boolean>, n long, texts binary"))
        n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.buckets = max(1, -(-n // self.bucket_tokens), min(LEAST_BUCKETS, -(-n // SMALL_BUCKET_TOKENS)))
        # A word of more than half a bucket is more than ``share`` of some block; what blocks below that leave out is a quarter of a bucket at most.
        heavy = self.blocks.select("texts").mapInArrow(_heavy(self.bucket_tokens / 4 / max(1, n)), "w long, n long")
        found = heavy.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") > self.bucket_tokens / 4).collect() if self.buckets > 1 else []
        self.hot = np.sort(np.array([r["w"] for r in found], np.int64).view(np.uint64))

    def _first(self) -> None:
        asked = self.blocks.select("block", "texts", "held_out").mapInArrow(_requests(self.buckets, self.hot), "bucket int, block long, data binary")
        self.counted = self._keep(asked.groupBy("bucket").applyInPandas(_count(self.buckets, self.hot), KINDS), "kind")
        total = _numbers(self.counted)
        get = lambda x: total.get(x, 0)
        hot_words, hot_customers = (np.array([get(FIRST_HOT + 2 * i + j) for i in range(len(self.hot))], np.int64) for j in (0, 1))
        v = get(DISTINCT) + int((hot_words > 0).sum())
        self.v, self.n = v, get(TOKENS)
        self.state = {
            "base": 1.0 / (v + 1), "d1": _discount(get(TOP_ONES), get(TOP_TWOS)), "d2": _discount(get(ONES), get(TWOS)), "customers": get(CUSTOMERS), "tables": v,
            "hot_words": hot_words, "hot_customers": hot_customers, "hot_tables": np.minimum(hot_customers, 1),
        }

    def _sample(self, rounds: int, burn: int) -> None:
        self.contexts = self._keep(_of(self.counted, CONTEXT).groupBy("bucket").applyInPandas(_meet_contexts, KINDS), "kind")
        told, seated, self.samples, self.rounds = _of(self.contexts, VALUES), None, [], []
        rng = np.random.default_rng([self.seed, 0])
        for r in range(1, rounds + 1):
            if not self.n:
                break
            s = self.state
            state = [_of(self.counted, STATIC), told] + ([_of(seated, TABLES)] if seated is not None else [])
            before, seated = seated, self._keep(_union(state).groupBy("bucket").applyInPandas(_seat_bucket(self.buckets, s, r, self.seed), KINDS), "kind")
            total = _numbers(seated)
            hot = np.array([total.get(FIRST_HOT + 2 * i + 1, 0) for i in range(len(self.hot))], np.int64)
            hot_tables = draw(hot, np.full(len(hot), s["base"]), (s["tables"] - s["hot_tables"]).astype(float), s["d1"], rng)
            self.state = s | {"round": r, "customers": total.get(CUSTOMERS, 0), "tables": total.get(TOP_TABLES, 0) + int(hot_tables.sum()), "hot_customers": hot, "hot_tables": hot_tables}
            summed = self._keep(_union([_of(self.contexts, LISTENERS), _of(seated, VALUES)]).groupBy("bucket").applyInPandas(_tell_tables(r), KINDS), "kind")
            told = _of(summed, VALUES)
            if r > burn or r == rounds:
                self.samples.append(self.state)
                self.rounds += [_of(seated, TABLES), _of(summed, CONTEXT)]

    def answers(self) -> DataFrame:
        parts = [_of(self.counted, STATIC, WORDS, ASKED), _of(self.contexts, HOME), *self.rounds]
        return _union(parts).groupBy("bucket").applyInPandas(_guarded(_answer(self.buckets, self.samples)), "for_block long, bucket int, answer binary")

    def discard(self, *kept: DataFrame) -> None:
        """Delete the model's tables but those given."""
        discard(*[x for x in self.tables if not any(x is y for y in kept)])
        self.tables = list(kept)


def _guarded(run):
    """Buckets that nobody asked have no answer."""

    def guarded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows) if (rows["kind"] == ASKED).any() else pd.DataFrame({"for_block": [], "bucket": [], "answer": []})

    return guarded


def _score(buckets: int, hot: np.ndarray, samples: list[dict], v: int, n: int, by_token: bool):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", *(["token_scores"] if by_token else [])]
    flat = np.log10(n + 0.1 * (v + 1))

    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, held, data in zip(texts["doc_id"], texts["held_out"], texts["texts"], strict=True):
            ask = Request(*unpack(data), buckets, hot)
            m, size = len(samples), len(ask.words)
            c, customers, count, seated = np.zeros(size), np.zeros(size), np.zeros(len(ask.word)), np.zeros(len(ask.word))
            guests, top, tables = (np.zeros((m, size)) for _ in range(3))
            for k, answer in zip(answers["bucket"], answers["answer"], strict=True):
                pairs, own = ask.part(int(k))
                contexts = own[ask.home[own] == int(k)]
                got = unpack(answer)
                c[own] = got[0]
                for i in range(m):
                    guests[i, own], top[i, own], tables[i, contexts] = got[1 + i], got[1 + m + i], got[2 + 2 * m + i]
                customers[contexts] = got[1 + 2 * m]
                count[pairs] = got[-2]
                seated[pairs] = np.minimum(got[-2], 1)
                seated[pairs[got[-2] > 1]] = got[-1] / m if m else 0
            if m:
                p = np.zeros(len(ask.word))
                for i, s in enumerate(samples):
                    p += (STRENGTH + s["d2"] * tables[i][ask.context]) * top_probability(guests[i], top[i], s)[ask.word]
                p = (count - samples[0]["d2"] * seated + p / m) / (STRENGTH + customers[ask.context])
            else:
                p = np.ones(len(ask.word))
            scores, plain = np.log10(p)[ask.pair], (np.log10(c + 0.1) - flat)[ask.tokens]
            columns = [list(ids), list(held), ask.lengths, np.add.reduceat((c[ask.tokens] > 0).astype(np.int64), ask.starts), n, np.add.reduceat(plain, ask.starts), np.add.reduceat(scores, ask.starts)]
            if by_token:
                columns.append(np.split(scores, ask.starts[1:]))
            out.append(pd.DataFrame(dict(zip(names, columns, strict=True))))
        return pd.concat(out) if out else pd.DataFrame({x: pd.Series([], dtype=object) for x in names})

    return run


def score_all(docs: DataFrame, by_token: bool = False, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; ``by_token`` adds the log10 probability of each token."""
    model = Model(docs, **options)
    schema = f"doc_id {model.kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + (", token_scores array<double>" if by_token else "")
    run = _score(model.buckets, model.hot, model.samples, model.v, model.n, by_token)
    answers = stored(model.answers())
    model.discard(model.blocks)
    out = stored(model.blocks.groupBy("block").cogroup(answers.groupBy("for_block")).applyInPandas(run, schema))
    discard(answers)
    model.discard()
    return out


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) a token, from the rows of ``score_all``."""
    each = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))
