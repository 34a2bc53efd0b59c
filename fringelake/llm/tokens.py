"""Token counts under a unigram vocabulary, without making the tokens.

Text is cut at Unicode white space; each word is tokenized behind the mark
``▁``. An Aho-Corasick automaton over the vocabulary lists all pieces that end at
each character; dynamic programming carries the best score and its number of
pieces. Rules of ties and unknowns are those of the public unigram tokenizers:
a later candidate replaces an earlier one only with a greater score, candidates come
by rising start (longest piece first); a character that no one-character piece
covers may be unknown at 10 below the least score; unknown neighbours are one
unknown, which costs one token, or its bytes if the vocabulary has byte pieces.

The vocabulary (pieces and scores) is read from a file by the driver and
broadcast; it has at most ``MOST_PIECES`` pieces.

Cases: null and empty texts have 0 tokens; equal rows have equal counts; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MOST_PIECES = 4_000_000
CACHE = 400_000
#: The characters with the Unicode property White_Space.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_counters: dict = {}


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MOST_PIECES:
        raise ValueError(f"{path} has more than {MOST_PIECES} pieces")
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """word -> number of tokens; forgets all at ``CACHE`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{i:02X}>" in pieces for i in range(256))

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        size = len(text)
        score, pieces, last_unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        at = 0
        single = False  # a piece of the one character before ``at``
        ends = self.automaton.iter(text)
        item = next(ends, None)
        for end in range(1, size + 1):
            at, single, chosen = end, False, None
            best = 0.0
            while item is not None and item[0] == end - 1:  # longest first
                length, value = item[1]
                single = single or length == 1
                here = score[end - length] + value
                if chosen is None or here > best:
                    best, chosen = here, length
                item = next(ends, None)
            if not single:
                here = score[end - 1] + self.unknown
                if chosen is None or here > best:
                    best, chosen = here, 0
            score[end] = best
            if chosen:
                pieces[end] = pieces[end - chosen] + 1
            else:
                last_unknown[end] = True
                grown = len(text[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not last_unknown[end - 1])
                pieces[end] = pieces[end - 1] + grown
        return pieces[size]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens for every document, under ``vocabulary`` or that of the file ``path``."""
    pieces = vocabulary or read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    token = hashlib.sha256(repr(pieces).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _counters:  # kept for the worker's next tasks
            _counters.clear()
            _counters[token] = Counter(shared.value)
        counter = _counters[token]
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                found = [x for x in SPACE.split(text.as_py() or "") if x]
                words.append(len(found))
                tokens.append(sum(map(counter.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
