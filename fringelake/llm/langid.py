"""Language identification by string kernels.

The kernel of two texts is the normalised number of character n-grams (blended
spectrum, n = 1 to 4, presence only) they share. Landmark documents give the
Nyström map; one-versus-rest kernel ridge regression is solved in that space.
Texts are scored by batched matrix products: the presence rows of a batch, as one sparse
matrix, times the landmark presence matrix folded with the dual weights.

The model is fitted on a bounded sample: at most ``sample_per_language``
documents of each language, and of them ``landmarks`` landmarks or two a language
if that is more, each language having one at least. Every language is learned; the model has 2**16
numbers for each, and the sample grows with their number. All documents are
scored over their whole text.

Cases: a text that is null or has no letter is ``und`` with score 0; null
languages are not learned; without any training row all texts are ``und``; ties
go to the language first in code-point order; equal rows get equal results.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .charfeat import presence
from .common import chunks
from .toxicity import held_out

SIZES = range(1, 5)
BITS = 16
LANDMARKS = 192
SAMPLE_PER_LANGUAGE = 300
#: Entries of a sparse batch matrix that are multiplied at a time.
ENTRIES = 500_000
RIDGE = 1e-2
DIVISOR, HELD_OUT = 5, 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch["text"]):
            part = batch.slice(a, b - a)
            found = [x.astype(np.int32).tobytes() for x in presence(part["text"], SIZES, BITS, letters_only=True)]
            yield pa.RecordBatch.from_arrays([part["lang"], part["place"], pa.array(found, pa.binary())], ["lang", "place", "features"])


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Unit-length presence rows."""
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, x in enumerate(rows):
        if len(x):
            out[i, x] = 1 / np.sqrt(len(x))
    return out


def landmark_places(langs: list[str], landmarks: int) -> list[int]:
    """Evenly spaced places, ``landmarks`` or two for each language if that is more, and a place of every language."""
    first = {}
    for i, x in enumerate(langs):
        first.setdefault(x, i)
    count = min(len(langs), max(landmarks, 2 * len(first)))
    places = {i * len(langs) // count for i in range(count)}
    seen = {langs[i] for i in places}
    return sorted(places | {i for x, i in first.items() if x not in seen})


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray]:
    """(languages, weight of each n-gram for each language)."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((1 << BITS, 0), np.float32)
    land = matrix([rows[i] for i in landmark_places(langs, landmarks)])
    cross = np.concatenate([matrix(rows[i : i + 256]) @ land.T for i in range(0, len(rows), 256)]).astype(float)
    values, vectors = np.linalg.eigh((land @ land.T).astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: k(x, land) @ root
    mapped = cross @ root
    targets = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Languages weigh alike, whatever their number of rows.
    counts = Counter(langs)
    share = np.array([1.0 / counts[x] for x in langs])[:, None]
    dual = np.linalg.solve(mapped.T @ (share * mapped) + RIDGE * np.eye(mapped.shape[1]), mapped.T @ (share * targets))
    return names, (land.T @ (root @ dual).astype(np.float32)).astype(np.float32)


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(DIVISOR, HELD_OUT))
    # Of each language, the rows with the least hash of their id.
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * sample_per_language / n + 20 / n))])
    place = F.xxhash64("doc_id", F.lit(11))
    unit = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    sample = learn.filter(unit < F.try_element_at(share, F.col("lang"))).select("text", "lang", unit.alias("place"))
    found = sample.mapInArrow(_features, "lang string, place double, features binary").collect()
    found.sort(key=lambda r: (r["lang"], r["place"], bytes(r["features"])))
    kept = [r for _, group in itertools.groupby(found, key=lambda r: r["lang"]) for r in itertools.islice(group, sample_per_language)]
    return fit([np.frombuffer(r["features"], np.int32) for r in kept], [r["lang"] for r in kept])


def sparse_product(rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The product of a sparse 0/1 matrix, given by the sorted columns of each row, with a dense one."""
    out = np.zeros((len(rows), table.shape[1]))
    sizes = np.array([len(x) for x in rows], np.int64)
    group = np.cumsum(sizes) // ENTRIES
    for g in np.unique(group):
        own = np.flatnonzero((group == g) & (sizes > 0))
        if len(own):
            starts = np.cumsum(sizes[own]) - sizes[own]
            out[own] = np.add.reduceat(table[np.concatenate([rows[i] for i in own])], starts, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all columns of ``docs`` (which needs ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast((names, weights))

    def run(batches):
        languages, table = shared.value
        said = np.array([*languages, "und"], dtype=object)
        for batch in batches:
            for a, b in chunks(batch["text"]):
                part = batch.slice(a, b - a)
                rows = list(presence(part["text"], SIZES, BITS, letters_only=True))
                sizes = np.array([len(x) for x in rows], np.int64)
                blank = np.asarray(pc.fill_null(pc.invert(pc.match_substring_regex(part["text"], r"\p{L}")), True).to_numpy(zero_copy_only=False), dtype=bool)
                none = blank | (sizes == 0) | (not languages)
                if languages:
                    f = sparse_product(rows, table) / np.sqrt(np.maximum(sizes, 1))[:, None]
                    best = np.argmax(f, axis=1)
                    sure = np.clip((f[np.arange(len(rows)), best] + 1) / 2, 0, 1)
                else:
                    best, sure = np.zeros(len(rows), np.int64), np.zeros(len(rows))
                found = said[np.where(none, len(languages), best)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(np.where(none, 0.0, sure), pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    names, weights = train(docs)
    return predict(docs.select("doc_id", "text", held_out(DIVISOR, HELD_OUT).alias("held_out")), names, weights).drop("text")
