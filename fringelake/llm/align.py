"""Alignment of two tokenizers: groups of tokens that end together, and how often ids are linked.

Python only tokenises; all else are Spark's higher-order functions and joins.

1. A text behind a space is cut at each space that follows a character which is not
   white space, spaces at the end stay with the last word. No token of either vocabulary
   spans such a place (checked on the vocabulary; else whole texts are encoded), so a
   unit has the same tokens everywhere. A row holds the distinct units of some texts, with the
   ids and the byte offsets at which tokens end, and each text as a list of units.
2. ``array_intersect`` of a unit's ends gives its groups. The union of the ends cuts it into
   segments, each within one token of A and one of B: those are exactly the pairs that
   overlap. Which token a segment or a group belongs to is looked up by its byte, for
   a row also holds the place of each byte's token. Groups and links of a text are
   those of its units.
3. Pairs are counted once a document. Frequent pairs (``FREQUENT`` at most) are
   broadcast and answer most links where they are read; the others are summed by document
   and pair before they are shuffled to their counts.

Cases: null and empty texts, and texts that a tokenizer alters, have no tokens and
zeros, with '' as digest; equal rows have equal results, and each counts as a document of
its own; null ids stay; texts of any length are taken whole; an empty table gives no
rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, expand, stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Largest vocabulary file that is broadcast.
FILE_BYTES = 64 << 20
#: Pairs of ids that are broadcast at most (about 60 bytes each).
FREQUENT = 250_000
#: Units and bytes of units that a worker remembers, units encoded at once, bytes of text of a batch.
UNITS, UNIT_BYTES, AT_ONCE, BATCH = 150_000, 8 << 20, 2_000, 2 << 20
MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")
_ODD = re.compile(r"\s ")

_encoders: dict = {}


def _byte_level() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode("utf-8", "surrogatepass")


class Side:
    """Tokens of one vocabulary for the units seen so far."""

    def __init__(self, token_bytes: list[bytes], encode):
        self.token_bytes, self.encode = token_bytes, encode
        self.sizes = np.array([len(x) for x in token_bytes], np.int32)
        self.clear()

    def clear(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.count = array("q"), array("q")

    def add(self, units: list[str], want: list[bytes]) -> np.ndarray:
        """Encode units; for each, whether its tokens give its bytes ``want`` back."""
        lists = self.encode(units)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(count.sum())
        ids, end = np.fromiter(chain.from_iterable(lists), np.int32, total), self.used + total
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.int32)])
        self.ids[self.used : end] = ids
        last = np.cumsum(count)
        self.first.frombytes((self.used + last - count).tobytes())
        self.count.frombytes(count.tobytes())
        self.used = end
        # Units of the right sizes whose bytes agree in a row agree one by one.
        sizes = np.concatenate([[0], np.cumsum(self.sizes[ids], dtype=np.int64)])
        same = sizes[last] - sizes[last - count] == np.fromiter(map(len, want), np.int64, len(want))
        if not same.all() or b"".join(map(self.token_bytes.__getitem__, ids.tolist())) != b"".join(want):
            same = np.array([b"".join(map(self.token_bytes.__getitem__, x)) == w for x, w in zip(lists, want, strict=True)], bool)
        return same


#: The public pattern at which byte-level tokenizers divide a text before they merge.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_rank(byte_level: bytes) -> bool:
    """Whether merging by the rank of what comes out gives the tokens of the byte-level vocabulary.

    It does if a merge only uses what earlier ones have made and every token comes out of its own bytes: what lies within a
    token's place is then merged as it would be alone, and its last merge is the vocabulary's.
    """
    from tokenizers import Tokenizer

    model = json.loads(byte_level)
    rules, before = model["model"], model.get("pre_tokenizer") or {}
    plain = rules.get("type") == "BPE" and not rules.get("dropout") and not rules.get("ignore_merges") and not rules.get("continuing_subword_prefix") and not rules.get("end_of_word_suffix")
    if not plain or model.get("normalizer") is not None or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        return False
    vocabulary, last = rules["vocab"], -1
    if any(c not in vocabulary for c in _byte_level()):
        return False
    for merge in rules["merges"]:
        x, y = merge.split(" ") if isinstance(merge, str) else merge
        i = vocabulary.get(x + y, -1)
        if i <= last or max(vocabulary.get(x, i), vocabulary.get(y, i)) >= i:
            return False
        last = i
    added = {x["content"] for x in model.get("added_tokens", [])}
    tokens = [t for t in vocabulary if t not in added]
    own = Tokenizer.from_str(byte_level.decode())
    own.pre_tokenizer = None  # tokens as they are, in the byte-level alphabet
    own.encode_special_tokens = True
    return all(x.ids == [vocabulary[t]] for t, x in zip(tokens, own.encode_batch(tokens, add_special_tokens=False), strict=True))


class Encoder:
    """Tokens of both vocabularies; a unit is remembered without the space that it starts with. ``ranked``: as ``by_rank`` says."""

    def __init__(self, byte_level: bytes, pieces: bytes, ranked: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        model = json.loads(byte_level)
        alphabet, vocabulary = _byte_level(), model["model"]["vocab"]
        added = {x["id"]: x["content"].encode() for x in model.get("added_tokens", [])}
        a_bytes = [b""] * (1 + max([*vocabulary.values(), *added]))
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(map(alphabet.__getitem__, token)) if i not in added else added[i]
        a = None if ranked else Tokenizer.from_str(byte_level.decode())
        if a is not None:
            a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        before = model.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and model.get("normalizer") is None and not any(MARK in x.lstrip(MARK) for x in names)
        if ranked:
            import tiktoken

            ranks = {a_bytes[i]: i for i in vocabulary.values() if i not in added}
            fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            encode = lambda units: [fast(" " + u) for u in units]
        else:
            encode = lambda units: [x.ids for x in a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        self.a = Side(a_bytes, encode)
        self.b = Side([_piece_bytes(x) for x in names], lambda units: b.encode(units, num_threads=1))
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.same: list[bool] = []
        self.held = 0
        self.a.clear()
        self.b.clear()

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        if text.startswith(" ") or text.endswith(" ") or _ODD.search(text):
            return [x[1:] for x in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, units: set[str]) -> None:
        if len(self.codes) > UNITS or self.held > UNIT_BYTES:
            self.clear()
        new = [u for u in units if u not in self.codes]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            self.codes.update(zip(some, range(len(self.codes), len(self.codes) + len(some)), strict=True))
            want = [b" " + u.encode("utf-8", "surrogatepass") for u in some]
            self.same += (self.a.add(some, want) & self.b.add(some, want)).tolist()
        self.held += sum(map(len, new))


def _lists(side: Side, codes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(ids, ends, place of the token that each byte belongs to) of each unit."""
    first, count = np.array(side.first)[codes], np.array(side.count)[codes]
    ids = side.ids[expand(first, count)]
    offsets = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(side.sizes[ids], dtype=np.int64)])
    ends = total[1:] - np.repeat(total[offsets[:-1]], count)
    at = pa.array(offsets.astype(np.int32))
    owners = np.repeat(np.arange(len(ids)) - np.repeat(offsets[:-1], count), side.sizes[ids])
    by_byte = pa.array(total[offsets].astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int32))), pa.ListArray.from_arrays(by_byte, pa.array(owners.astype(np.int32)))


def _whole(side: Side, codes: np.ndarray) -> bytes:
    return b"".join(side.token_bytes[i] for c in codes for i in side.ids[side.first[c] : side.first[c] + side.count[c]])


def _encoded(encoder: Encoder, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """One row: the distinct units of some texts with their tokens, and each document as the places of its units."""
    units = [encoder.units(t) if t else [] for t in texts]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
    encoder.learn(set(chain.from_iterable(units)))
    codes = np.fromiter(map(encoder.codes.__getitem__, chain.from_iterable(units)), np.int64, int(first[-1]))
    wrong = np.flatnonzero(~np.array(encoder.same, bool)[codes]) if len(codes) else codes
    if len(wrong):  # texts that a tokenizer alters have no tokens
        stays = np.ones(len(codes), bool)
        for k in np.unique(np.searchsorted(first, wrong, "right") - 1):
            own, want = codes[first[k] : first[k + 1]], b" " + texts[k].encode("utf-8", "surrogatepass")
            if not _whole(encoder.a, own) == want == _whole(encoder.b, own):
                stays[first[k] : first[k + 1]] = False
        first, codes = np.concatenate([[0], np.cumsum(stays)])[first], codes[stays]
    distinct, places = np.unique(codes, return_inverse=True)
    count = [np.concatenate([[0], np.cumsum(np.array(side.count)[distinct][places])]) for side in (encoder.a, encoder.b)]
    n_a, n_b = (pa.array(np.diff(c[first])) for c in count)
    lists_of = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(places.astype(np.int32)))
    docs = pa.StructArray.from_arrays([ids, n_a, n_b, lists_of], ["doc_id", "n_a", "n_b", "codes"])
    lists = pa.StructArray.from_arrays([x for side in (encoder.a, encoder.b) for x in _lists(side, distinct)], ["a_ids", "a_ends", "a_at", "b_ids", "b_ends", "b_at"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(lists), one(docs)], ["units", "docs"])


def encode(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """A row for about ``BATCH`` bytes of texts: units (ids, ends, and the place of each byte's token, of each distinct one) and docs (doc_id, n_a, n_b, codes: its units)."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        files = (a.read(FILE_BYTES + 1), b.read(FILE_BYTES + 1))
    if max(map(len, files)) > FILE_BYTES:
        raise ValueError(f"a vocabulary file has more than {FILE_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast((*files, by_rank(files[0])))
    token = hash(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _encoders:  # kept for the worker's next tasks
            _encoders.clear()
            _encoders[token] = Encoder(*shared.value)
        for batch in batches:
            for i, j in chunks(batch["text"], BATCH):
                part = batch.slice(i, j - i)
                yield _encoded(_encoders[token], part["doc_id"], part["text"].to_pylist())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"units array<struct<a_ids:array<int>,a_ends:array<int>,a_at:array<int>,b_ids:array<int>,b_ends:array<int>,b_at:array<int>>>, docs array<struct<doc_id:{kind},n_a:long,n_b:long,codes:array<int>>>")


def _part(ids: str, owner: str) -> str:
    """The ids of the tokens from the shared end before number k up to that at byte e, joined by commas."""
    first, last = f"get({owner}, coalesce(get(w, k - 1), 0))", f"get({owner}, e - 1)"
    several = f"array_join(transform(sequence({first}, {last}), i -> cast(get({ids}, i) as string)), ',')"
    return f"if({first} = {last}, cast(get({ids}, {last}) as string), {several})"


_PAIR = "shiftleft(cast({a} as bigint), 32) | {b}"
_JOINED = "array_join(cast({ids} as array<string>), ',')"
#: Units whose tokens all end together, and units that are one token on a side, are aligned without a search.
_ALIKE = f"struct(size(u.a_ids) as n, array_join(zip_with(u.a_ids, u.b_ids, (a, b) -> concat(a, '|', b)), ';') as groups, zip_with(u.a_ids, u.b_ids, (a, b) -> {_PAIR.format(a='a', b='b')}) as links)"
_ONE = f"struct(1 as n, concat({_JOINED.format(ids='u.a_ids')}, '|', {_JOINED.format(ids='u.b_ids')}) as groups, flatten(transform(u.a_ids, a -> transform(u.b_ids, b -> {_PAIR.format(a='a', b='b')}))) as links)"
#: Else the shared ends are bound to a lambda's variable, so that they are found once a unit.
_GROUPS = f"transform(w, (e, k) -> concat({_part('u.a_ids', 'u.a_at')}, '|', {_part('u.b_ids', 'u.b_at')}))"
_LINKS = f"transform(array_union(u.a_ends, u.b_ends), e -> {_PAIR.format(a='get(u.a_ids, get(u.a_at, e - 1))', b='get(u.b_ids, get(u.b_at, e - 1))')})"
_ANY = f"get(transform(array(array_intersect(u.a_ends, u.b_ends)), w -> struct(size(w) as n, array_join({_GROUPS}, ';') as groups, {_LINKS} as links)), 0)"
_SINGLE = f"struct(1 as n, concat(get(u.a_ids, 0), '|', get(u.b_ids, 0)) as groups, array({_PAIR.format(a='get(u.a_ids, 0)', b='get(u.b_ids, 0)')}) as links)"
_UNIT = f"if(size(u.a_ids) = 1 and size(u.b_ids) = 1, {_SINGLE}, if(u.a_ends = u.b_ends, {_ALIKE}, if(size(u.a_ids) = 1 or size(u.b_ids) = 1, {_ONE}, {_ANY})))"
_PARTS = "transform(d.codes, c -> get(aligned, c))"
_DOC = f"""get(transform(array({_PARTS}), p -> struct(d.doc_id as doc_id, d.n_a as n_a, d.n_b as n_b, aggregate(p.n, 0L, (s, n) -> s + n) as n_groups,
    array_join(p.groups, ';') as groups, flatten(p.links) as links)), 0)"""


def align(encoded: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (as text), links (A id << 32 | B id, an entry for each pair of tokens that overlap; in no order within a unit)."""
    aligned = encoded.withColumn("aligned", F.expr(f"transform(units, u -> {_UNIT})"))
    return aligned.select(F.explode(F.expr(f"transform(docs, d -> {_DOC})")).alias("d")).select("d.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs, best: how many documents hold each pair, and whether no pair of its A id is in more; a stored table."""
    counts = stored(aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as the vocabulary has ids
    return stored(counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their count of documents."""
    power = F.floor(F.log2("docs")).cast("int")
    above, least = 0, 0
    for p, n in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):  # 63 rows at most
        above += n
        if above > most:
            return 2 ** (p + 1)
        least = 2**p
    return least


def cross_align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``."""
    aligned = align(encode(docs, byte_level, pieces))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = stored(aligned.select("doc_id", F.monotonically_increasing_id().alias("rid"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"))
    counts = pair_counts(aligned)
    least = least_frequent(counts, frequent)
    known = F.broadcast(counts.filter(F.col("docs") >= least))
    links = aligned.select("rid", F.explode("links").alias("pair"))
    sums = links.join(known, "pair").groupBy("rid").agg(F.sum("docs").alias("count_sum"), F.sum("best").alias("n_best"))
    rest = counts.filter(F.col("docs") < least)
    if not rest.isEmpty():
        other = links.join(known, "pair", "left_anti").groupBy("rid", "pair").agg(F.count(F.lit(1)).alias("times")).join(rest, "pair")
        other = other.groupBy("rid").agg(F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
        sums = sums.unionByName(other).groupBy("rid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    narrow = aligned.select("doc_id", "rid", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256")
    return narrow.join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
