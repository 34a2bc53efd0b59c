"""Movies and images in HDF5 files: frames as rows, read by chunks.

``Frames`` is a Python data source. Its driver side reads what describes the file
(superblock, object headers, group and chunk B-trees); a partition is a range of frames
of one file, of which a task reads the bytes or chunks it needs. Superblocks of
versions 0 to 3, object headers 1 and 2, symbol-table and compact groups, contiguous, compact and
chunked layouts up to version 3, and the deflate, shuffle and checksum filters are
known; anything else raises an error that names it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import files_in, open_output, open_ranges

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
#: Bytes of frames that a partition aims at.
PARTITION = 32 << 20
STOKES, CIRCULAR = ("I", "Q", "U", "V"), ("RR", "LL", "RL", "LR")


@dataclass
class Node:
    """A group (``links``: name to address) or a dataset, with its attributes."""

    links: dict[str, int] = field(default_factory=dict)
    attributes: dict[str, object] = field(default_factory=dict)
    shape: tuple[int, ...] | None = None
    dtype: str | None = None
    layout: tuple | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


class File:
    """What an HDF5 file describes, read as it is asked for."""

    def __init__(self, path: str):
        self.file = open_ranges(path)
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError(f"{path} is no HDF5 file")
        version = head[8]
        if version <= 1:
            if head[13:15] != b"\x08\x08":
                raise ValueError("only offsets and lengths of 8 bytes are known")
            base = 24 + 4 * version
            self.root = struct.unpack_from("<Q", head, base + 32 + 8)[0]
        elif version <= 3:
            self.root = struct.unpack_from("<Q", head, 12 + 24)[0]
        else:
            raise ValueError(f"superblock version {version}")

    def close(self) -> None:
        self.file.close()

    def at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def get(self, path: str) -> Node:
        node = self.node(self.root)
        for name in filter(None, path.split("/")):
            if name not in node.links:
                raise KeyError(path)
            node = self.node(node.links[name])
        return node

    def node(self, place: int) -> Node:
        out = Node()
        for kind, data in self._messages(place):
            if kind == 0x01:
                out.shape = _shape(data)
            elif kind == 0x03:
                out.dtype = _dtype(data)
            elif kind == 0x06:
                name, target = _link(data)
                out.links[name] = target
            elif kind == 0x08:
                out.layout = _layout(data)
            elif kind == 0x0B:
                out.filters = _filters(data)
            elif kind == 0x0C:
                name, value = self._attribute(data)
                out.attributes[name] = value
            elif kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", data)
                out.links |= dict(self._symbols(tree, self._heap(heap)))
        return out

    def _messages(self, place: int) -> Iterator[tuple[int, bytes]]:
        head = self.at(place, 32)
        new = head[:4] == b"OHDR"
        if new:
            flags, start = head[5], 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
            width = 1 << (flags & 3)
            blocks = [(place + start + width, int.from_bytes(head[start : start + width], "little"))]
            extra = 2 if flags & 4 else 0
        else:
            if head[0] != 1:
                raise ValueError(f"object header version {head[0]}")
            blocks = [(place + 16, struct.unpack_from("<I", head, 8)[0])]
        while blocks:
            start, size = blocks.pop(0)
            block, k = self.at(start, size), 0
            while k + (4 + extra if new else 8) <= len(block):
                if new:
                    kind, length = struct.unpack_from("<BH", block, k)
                    k += 4 + extra
                else:
                    kind, length = struct.unpack_from("<HH", block, k)
                    k += 8
                data = block[k : k + length]
                k += length
                if kind == 0x10:
                    at, size = struct.unpack_from("<QQ", data)
                    blocks.append((at + 4, size - 8) if new else (at, size))
                elif kind:
                    yield kind, data

    def _heap(self, place: int) -> bytes:
        head = self.at(place, 32)
        size, _, data = struct.unpack_from("<QQQ", head, 8)
        return self.at(data, size)

    def _symbols(self, place: int, heap: bytes) -> Iterator[tuple[str, int]]:
        head = self.at(place, 24)
        if head[:4] == b"SNOD":
            count = struct.unpack_from("<H", head, 6)[0]
            entries = self.at(place + 8, 40 * count)
            for k in range(count):
                name, target = struct.unpack_from("<QQ", entries, 40 * k)
                yield heap[name : heap.index(b"\0", name)].decode(), target
            return
        count = struct.unpack_from("<H", head, 6)[0]
        body = self.at(place + 24, 16 * count + 8)
        for k in range(count):
            yield from self._symbols(struct.unpack_from("<Q", body, 16 * k + 8)[0], heap)

    def _attribute(self, data: bytes) -> tuple[str, object]:
        version, sizes = data[0], struct.unpack_from("<HHH", data, 2)
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        k = 9 if version == 3 else 8
        name = data[k : k + sizes[0]].split(b"\0")[0].decode()
        k += pad(sizes[0])
        dtype = _dtype(data[k : k + sizes[1]])
        k += pad(sizes[1])
        shape = _shape(data[k : k + sizes[2]])
        k += pad(sizes[2])
        if dtype == "vlen":
            length, place, index = struct.unpack_from("<IQI", data, k)
            return name, self._global(place, index)[:length].decode()
        values = np.frombuffer(data, dtype, int(np.prod(shape)), k)
        text = [x.decode() for x in values.ravel()] if values.dtype.kind == "S" else values.ravel().tolist()
        return name, text[0] if len(text) == 1 else text

    def _global(self, place: int, index: int) -> bytes:
        size = struct.unpack_from("<Q", self.at(place, 16), 8)[0]
        block, k = self.at(place, size), 16
        while k + 16 <= size:
            own, _, _, length = struct.unpack_from("<HHIQ", block, k)
            if own == index:
                return block[k + 16 : k + 16 + length]
            k += 16 + -(-length // 8) * 8
        raise ValueError("no such object in the global heap")

    def chunks(self, node: Node) -> list[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, place, size, filters left out) of a chunked dataset."""
        rank, out, open_nodes = len(node.shape), [], [node.layout[1]]
        width = 8 + 8 * (rank + 1)
        while open_nodes:
            place = open_nodes.pop()
            if place == NOWHERE:
                continue
            head = self.at(place, 24)
            level, count = head[5], struct.unpack_from("<H", head, 6)[0]
            body = self.at(place + 24, count * (width + 8) + width)
            for k in range(count):
                size, mask, *offsets = struct.unpack_from(f"<II{rank + 1}Q", body, k * (width + 8))
                child = struct.unpack_from("<Q", body, k * (width + 8) + width)[0]
                if level:
                    open_nodes.append(child)
                else:
                    out.append((tuple(offsets[:rank]), child, size, mask))
        return sorted(out)

    def read(self, node: Node, first: int = 0, last: int | None = None) -> np.ndarray:
        """The rows from ``first`` up to ``last`` of a dataset's first axis; a dataset without axes as a whole."""
        dtype = np.dtype(node.dtype)
        if not node.shape:
            kind, place, *_ = node.layout
            data = place if kind == "compact" else self.at(place, dtype.itemsize)
            return np.frombuffer(data, dtype, 1)[0]
        last = node.shape[0] if last is None else last
        shape = (max(last - first, 0), *node.shape[1:])
        if node.layout[0] != "chunked":
            row = int(np.prod(node.shape[1:], dtype=np.int64)) * dtype.itemsize
            if node.layout[0] == "compact":
                data = node.layout[1][first * row : last * row]
            else:
                data = b"\0" * (row * shape[0]) if node.layout[1] == NOWHERE else self.at(node.layout[1] + first * row, row * shape[0])
            return np.frombuffer(data, dtype).reshape(shape)
        out, cells = np.zeros(shape, dtype), node.layout[2]
        for offsets, place, size, mask in self.chunks(node):
            if offsets[0] >= last or offsets[0] + cells[0] <= first:
                continue
            block = np.frombuffer(_unfiltered(self.at(place, size), node.filters, mask, dtype.itemsize), dtype).reshape(cells)
            a, b = max(first, offsets[0]), min(last, offsets[0] + cells[0], node.shape[0])
            ends = [min(o + c, s) for o, c, s in zip(offsets, cells, node.shape, strict=True)]
            inner = tuple(slice(o, e) for o, e in zip(offsets[1:], ends[1:], strict=True))
            own = tuple(slice(0, e - o) for o, e in zip(offsets[1:], ends[1:], strict=True))
            out[(slice(a - first, b - first), *inner)] = block[(slice(a - offsets[0], b - offsets[0]), *own)]
        return out


def _shape(data: bytes) -> tuple[int, ...]:
    rank = data[1]
    return struct.unpack_from(f"<{rank}Q", data, 8 if data[0] == 1 else 4)


def _dtype(data: bytes) -> str:
    kind, bits, size = data[0] & 15, data[1], struct.unpack_from("<I", data, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return f"{order}{'i' if bits & 8 else 'u'}{size}"
    if kind == 1:
        return f"{order}f{size}"
    if kind == 3:
        return f"S{size}"
    if kind == 9 and bits & 15 == 1:
        return "vlen"
    raise ValueError(f"data type of class {kind}")


def _link(data: bytes) -> tuple[str, int]:
    flags, k = data[1], 2
    if flags & 8:
        if data[k]:
            raise ValueError("only hard links are known")
        k += 1
    k += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    length = int.from_bytes(data[k : k + width], "little")
    k += width
    return data[k : k + length].decode(), struct.unpack_from("<Q", data, k + length)[0]


def _layout(data: bytes) -> tuple:
    if data[0] != 3:
        raise ValueError(f"data layout version {data[0]}")
    if data[1] == 0:
        size = struct.unpack_from("<H", data, 2)[0]
        return "compact", data[4 : 4 + size]
    if data[1] == 1:
        return "contiguous", struct.unpack_from("<Q", data, 2)[0]
    rank = data[2]
    return "chunked", struct.unpack_from("<Q", data, 3)[0], struct.unpack_from(f"<{rank}I", data, 11)[:-1]


def _filters(data: bytes) -> list[tuple[int, tuple[int, ...]]]:
    out, k = [], 8 if data[0] == 1 else 2
    for _ in range(data[1]):
        number = struct.unpack_from("<H", data, k)[0]
        named = data[0] == 1 or number >= 256
        length, (_, count) = struct.unpack_from("<H", data, k + 2)[0] if named else 0, struct.unpack_from("<HH", data, k + (4 if named else 2))
        k += 8 if named else 6
        k += -(-length // 8) * 8 if data[0] == 1 else length
        out.append((number, struct.unpack_from(f"<{count}I", data, k)))
        k += 4 * count + (4 if data[0] == 1 and count % 2 else 0)
    return out


def _unfiltered(data: bytes, filters: list[tuple[int, tuple[int, ...]]], mask: int, size: int) -> bytes:
    for k, (number, _) in reversed(list(enumerate(filters))):
        if mask >> k & 1:
            continue
        if number == 1:
            data = zlib.decompress(data)
        elif number == 2:
            n = len(data) // size
            data = np.frombuffer(data[: n * size], np.uint8).reshape(size, n).T.tobytes() + data[n * size :]
        elif number == 3:
            data = data[:-4]
        else:
            raise ValueError(f"filter {number}")
    return data


SCHEMA = "file string, frame long, time double, product string, width int, pix array<double>, header string"


@dataclass
class Part(InputPartition):
    path: str
    product: str
    first: int
    last: int


class FramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.product = options["path"], options.get("product")

    def partitions(self) -> list[Part]:
        """Ranges of whole frames, of whole chunks where there are chunks."""
        out = []
        for path in files_in(self.path):
            file = File(path)
            head = file.get("header").attributes
            names = [self.product] if self.product else [p for p in (CIRCULAR if head.get("polrep") == "circ" else STOKES) if p in file.get("").links]
            for name in names:
                node = file.get(name)
                if not node.shape:
                    continue
                frame = max(1, int(np.prod(node.shape[1:], dtype=np.int64)) * np.dtype(node.dtype).itemsize)
                least = node.layout[2][0] if node.layout[0] == "chunked" else 1
                step = max(1, PARTITION // frame // least) * least
                out += [Part(path, name, a, min(a + step, node.shape[0])) for a in range(0, node.shape[0], step)]
            file.close()
        return out or [Part("", "", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            file = File(part.path)
            node, head = file.get(part.product), json.dumps(file.get("header").attributes, sort_keys=True)
            times = file.read(file.get("times"), part.first, part.last).astype(float)
            size, width = int(np.prod(node.shape[1:], dtype=np.int64)), node.shape[-1]
            step = max(1, (4 << 20) // max(size * 8, 1))
            for a in range(part.first, part.last, step):
                b = min(a + step, part.last)
                values = file.read(node, a, b).astype(float).reshape(b - a, size)
                pix = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * size), pa.array(values.ravel()))
                same = lambda x, kind: pa.array([x] * (b - a), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(part.path, pa.string()), pa.array(np.arange(a, b)), pa.array(times[a - part.first : b - part.first]), same(part.product, pa.string()), same(width, pa.int32()), pix, same(head, pa.string())], [x.split(" ")[0] for x in SCHEMA.split(", ")])
            file.close()


class Frames(DataSource):
    """Frames of movie files: options ``path`` (a file or a folder) and ``product`` (one of I, Q, U, V, RR, LL, RL, LR; all that are there)."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_movie"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)


def read_movie(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """(file, frame, time in hours, product, width, pix, header as JSON) of all frames of a movie file or of a folder's."""
    spark.dataSource.register(Frames)
    reader = spark.read.format("hdf5_movie")
    return (reader.option("product", product) if product else reader).load(path)


def read_image(path: str) -> dict:
    """An image of a simulation's file: arrays I, Q, U and V in Jy a pixel, pixel (radians), freq (Hz) and time (hours)."""
    file = File(path)
    number = lambda name: float(file.read(file.get(f"header/{name}")))
    names = file.get("").links
    data = file.read(file.get("pol"))[:, :, :4] if "pol" in names else np.pad(file.read(file.get("unpol"))[:, :, None], ((0, 0), (0, 0), (0, 3)))
    # The file's first axis goes right, its second up.
    data = np.flip(data.transpose(1, 0, 2), axis=0) * number("scale")
    # Microarcseconds of a radian as simulations take it, and radians of a microarcsecond.
    pixel = number("camera/dx") / number("dsource") * number("units/L_unit") * 2.06265e11 / number("camera/nx") * (np.pi / 180 / 3600e6)
    time = number("t") * number("units/T_unit") / 3600 if "t" in file.get("header").links else 0.0
    out = {p: data[:, :, k] for k, p in enumerate(STOKES)} | {"pixel": pixel, "freq": number("freqcgs"), "time": time}
    file.close()
    return out


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _object(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<HHB3x", kind, len(_padded(x)), 0) + _padded(x) for kind, x in messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _space(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBBx4x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


#: Data type messages: little-endian IEEE doubles, and text of a fixed number of bytes.
DOUBLE = struct.pack("<BBBBI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)


def _text_type(size: int) -> bytes:
    return struct.pack("<B3xI", 0x13, size)


def movie_head(header: dict[str, str], shapes: dict[str, tuple[int, ...]]) -> tuple[bytes, dict[str, int]]:
    """The start of a movie file of version 0, and the place of each dataset of doubles that must follow it."""
    names = sorted(["header", *shapes])
    heap, at = b"\0" * 8, {}
    for n in names:
        at[n] = len(heap)
        heap += _padded(n.encode() + b"\0")
    attributes = []
    for k, v in header.items():
        value = str(v).encode() or b" "
        attributes.append((0x0C, struct.pack("<BxHHH", 1, len(k) + 1, 8, 8) + _padded(k.encode() + b"\0") + _text_type(len(value)) + _space(()) + value))
    place = 96
    root = place
    place += len(_object([(0x11, b"\0" * 16)]))
    tree, place = place, place + 24 + 16 * 32 + 8
    # One leaf holds all names: twice the file's leaf constant of 8 entries.
    leaf, place = place, place + 8 + 40 * 16
    heap_head, place = place, place + 32
    heap_data, place = place, place + len(heap)
    objects, data = {}, {}
    layout = lambda where, size: (0x08, struct.pack("<BBQQ", 3, 1, where, size))
    make = lambda n: _object([(0x01, _space((0,))), (0x03, _text_type(10)), layout(NOWHERE, 0), *attributes]) if n == "header" else _object([(0x01, _space(shapes[n])), (0x03, DOUBLE), layout(data.get(n, 0), 8 * int(np.prod(shapes[n])))])
    for n in names:
        objects[n] = place
        place += len(make(n))
    for n in shapes:
        data[n] = place
        place += 8 * int(np.prod(shapes[n]))
    out = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 8, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, place, NOWHERE)
    out += struct.pack("<QQI4xQQ", 0, root, 1, tree, heap_head)
    out += _object([(0x11, struct.pack("<QQ", tree, heap_head))])
    out += (b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, leaf, at[names[-1]])).ljust(24 + 16 * 32 + 8, b"\0")
    out += (b"SNOD" + struct.pack("<BxH", 1, len(names)) + b"".join(struct.pack("<QQI4x16x", at[n], objects[n], 0) for n in names)).ljust(8 + 40 * 16, b"\0")
    out += b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, heap_data) + heap
    for n in names:
        out += make(n)
    return out, data


def write_movies(frames: DataFrame, path: str, header: dict[str, str] | None = None) -> DataFrame:
    """A file ``<movie_id>.h5`` in the folder ``path`` for each movie of (movie_id, time, width, pix); returns (movie_id, n_frames, file).

    Frames are sorted by time and stream into the file, their times after them, so that a task holds a batch and 8 bytes a frame of its movie; all frames of a movie have one size.
    A frame without time comes first, its time not a number.
    """
    from pyspark.sql import functions as F

    named = frames.filter(F.col("movie_id").isNotNull())
    rows = named.select("movie_id", F.lit(None).cast("long").alias("n"), F.col("width").cast("int").alias("width"), F.lit(None).cast("int").alias("size"), F.col("time").cast("double").alias("time"), F.col("pix").cast("array<double>").alias("pix"))
    # A movie's first row tells its size. It comes by a union: Spark may deal a movie's rows to several tasks after a join.
    sizes = named.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"), F.first("width").cast("int").alias("width"), F.first(F.size("pix")).alias("size"))
    rows = rows.unionByName(sizes.withColumns({"time": F.lit(None).cast("double"), "pix": F.lit(None).cast("array<double>")}))
    head = {"mjd": "0", "psize": "1e-10", "source": "SOURCE", "ra": "0.0", "dec": "0.0", "rf": "230000000000.0", "polrep": "stokes", "pol_prim": "I"} | (header or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, times, done = None, [], []

        def close() -> None:
            if out is not None:
                out.write(np.concatenate(times).tobytes())
                out.close()

        for batch in batches:
            movies, pix, heads = batch["movie_id"].to_pylist(), batch["pix"], batch["n"].to_pylist()
            when = np.asarray(batch["time"].to_numpy(zero_copy_only=False), "<f8")
            firsts = [i for i, n in enumerate(heads) if n is not None]
            for a, b in zip([-1, *firsts], [*firsts, len(movies)], strict=True):
                if a >= 0:
                    close()
                    n, width = heads[a], batch["width"][a].as_py()
                    times, file = [], f"{path}/{movies[a]}.h5"
                    out = open_output(file)
                    start, _ = movie_head(head, {head["pol_prim"]: (n, batch["size"][a].as_py() // width, width), "times": (n,)})
                    out.write(start)
                    done.append((movies[a], n, file))
                if b > a + 1:
                    times.append(when[a + 1 : b])
                    out.write(np.asarray(pix.slice(a + 1, b - a - 1).flatten().to_numpy(zero_copy_only=False), "<f8").tobytes())
        close()
        ids, n, files = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(files, pa.string())], ["movie_id", "n_frames", "file"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(frames.schema["movie_id"].dataType)
    ordered = rows.repartition("movie_id").sortWithinPartitions("movie_id", F.col("n").isNull(), "time")
    return ordered.mapInArrow(run, f"movie_id {frames.schema['movie_id'].dataType.simpleString()}, n_frames long, file string")
