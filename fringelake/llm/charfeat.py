"""Presence of hashed character n-grams, whole texts, batch by batch.

n-grams are taken inside words framed by one blank on either side. A batch's
distinct words are hashed once; a document's presence set is the union of its
words' n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import expand, mix, split_words

BITS = 18


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def word_features(words: list[str], sizes: range, bits: int = BITS, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """CSR (pointers, feature numbers) of the n-grams of each word, in lower case."""
    joined = (" " + " ".join(words) + " ").lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if letters_only:
        points = points[letter_table()[points] | (points == 32)]
    blanks = np.flatnonzero(points == 32)
    word = np.searchsorted(blanks, np.arange(len(points)), side="right") - 1  # the word that a position, or the blank before it, belongs to
    last = np.concatenate([blanks, [len(points)]])[np.minimum(word + 1, len(blanks) - 1)]  # the blank after it
    points = points.astype(np.uint64)
    columns, valid = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(points):
            break
        count = len(points) - n + 1
        rolled = rolled[:count] * np.uint64(0x100000001B3) + points[n - 1 : n - 1 + count] + np.uint64(1)
        if n in sizes:
            column = np.zeros(len(points), np.int64)
            column[:count] = (mix(rolled ^ np.uint64(n << 56)) >> np.uint64(64 - bits)).astype(np.int64)
            columns.append(column)
            valid.append(np.arange(len(points)) + n - 1 <= last)
    if not columns or not words:
        return np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int64)
    mask = np.stack(valid, axis=1)
    mask[blanks[-1] :] = False  # nothing starts at the last blank
    totals = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return totals[blanks], np.stack(columns, axis=1)[mask]


def presence(texts: pa.Array, sizes: range, bits: int = BITS, letters_only: bool = False, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text's lower-cased words, or of their letters.

    ``wanted`` marks the features that matter to the caller; others are left out.
    """
    codes, values, offsets = split_words(texts)
    pointers, features = word_features(values.to_pylist(), sizes, bits, letters_only)
    if wanted is not None:
        keep = wanted[features]
        pointers, features = np.concatenate([[0], np.cumsum(keep)])[pointers], features[keep]
    counts = np.diff(pointers)
    flags = np.zeros(1 << bits, bool)
    seen = np.zeros(len(values), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = codes[a:b]
        if b - a > 2000:
            seen[own] = True
            own = np.flatnonzero(seen)
            seen[own] = False
        found = features[expand(pointers[own], counts[own])]
        flags[found] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found
