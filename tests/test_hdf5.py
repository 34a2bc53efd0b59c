"""HDF5 movies and images: files of every layout that the reader knows, made here byte by byte."""

import json
import struct
import zlib

import numpy as np
import pytest

from fringelake.sources import hdf5

U64 = struct.Struct("<Q")


def node_v1(messages):
    return hdf5._object(messages)


def node_v2(messages):
    body = b"".join(struct.pack("<BHB", kind, len(x), 0) + x for kind, x in messages)
    return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0\0\0\0"


def link(name, place):
    return struct.pack("<BBB", 1, 0, len(name)) + name.encode() + U64.pack(place)


def chunked_file(frames, times, cells, attributes, filters=(1, 2)):
    """Superblock 2, new headers and links; frames in chunks behind shuffle, deflate and a checksum; B-tree of two levels."""
    parts, at = [b""], 48

    def put(data):
        nonlocal at
        parts.append(data)
        at += len(data)
        return at - len(data)

    rank = frames.ndim
    keys = []
    steps = [range(0, n, c) for n, c in zip(frames.shape, cells, strict=True)]
    for offsets in np.array(np.meshgrid(*steps, indexing="ij")).reshape(rank, -1).T:
        block = np.zeros(cells, "<f4")
        own = tuple(slice(o, min(o + c, n)) for o, c, n in zip(offsets, cells, frames.shape, strict=True))
        part = frames[own]
        block[tuple(slice(0, n) for n in part.shape)] = part
        data = block.tobytes()
        data = np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()
        data = zlib.compress(data) + b"abcd"
        keys.append((struct.pack(f"<II{rank + 1}Q", len(data), 0, *offsets, 0), put(data)))
    last = struct.pack(f"<II{rank + 1}Q", 0, 0, *[2**40] * rank, 0)

    def tree(level, entries):
        return put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(entries), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(k + U64.pack(c) for k, c in entries) + last)

    half = len(keys) // 2
    leaves = [(x[0][0], tree(0, x)) for x in (keys[:half], keys[half:]) if x]
    top = tree(1, leaves)
    single = struct.pack("<BBBBI", 0x11, 0x20, 31, 0, 4) + struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127)
    space2 = lambda shape: struct.pack("<BBBB", 2, len(shape), 0, 1) + struct.pack(f"<{len(shape)}Q", *shape)
    layout = struct.pack("<BBBQ", 3, 2, rank + 1, top) + struct.pack(f"<{rank + 1}I", *cells, 4)
    pipeline = struct.pack("<BB", 2, 3) + struct.pack("<HHHI", 2, 0, 1, 4) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0)
    movie = put(node_v2([(1, space2(frames.shape)), (3, single), (8, layout), (0x0B, pipeline)]))
    raw = np.asarray(times, ">f8").tobytes()
    big = struct.pack("<BBBBI", 0x11, 0x21, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    clock = put(node_v2([(1, space2((len(times),))), (3, big), (8, struct.pack("<BBH", 3, 0, len(raw)) + raw)]))
    heap = b"GCOL" + struct.pack("<B3xQ", 1, 16 + 32) + struct.pack("<HHIQ", 1, 1, 0, 5) + b"M 87*\0\0\0" + b"\0" * 8
    words = put(heap)
    rows = []
    for k, v in attributes.items():
        if k == "source":
            dtype, value = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + hdf5._text_type(1), struct.pack("<IQI", 5, words, 1)
        else:
            dtype, value = hdf5._text_type(len(v)), v.encode()
        space = space2(())
        rows.append((0x0C, struct.pack("<BBHHHB", 3, 0, len(k) + 1, len(dtype), len(space), 0) + k.encode() + b"\0" + dtype + space + value))
    more = b"".join(struct.pack("<BHB", kind, len(x), 0) + x for kind, x in rows[1:])
    block = put(b"OCHK" + more + b"\0\0\0\0")
    head = put(node_v2([(1, space2((0,))), (3, hdf5._text_type(10)), rows[0], (0x10, struct.pack("<QQ", block, len(more) + 8))]))
    root = put(node_v2([(6, link("header", head)), (6, link("times", clock)), (6, link("I", movie))]))
    start = hdf5.SIGNATURE + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, at, root) + b"\0\0\0\0"
    return start + b"".join(parts)


@pytest.mark.parametrize("cells", [(1, 5, 7), (3, 4, 4), (40, 2, 7)])
def test_chunked_movies(spark, tmp_path, cells, monkeypatch):
    monkeypatch.setattr(hdf5, "PARTITION", 600)
    rng = np.random.default_rng(1)
    frames = rng.normal(size=(23, 5, 7)).astype("f4")
    times = np.sort(rng.uniform(0, 24, 23))
    (tmp_path / "a.h5").write_bytes(chunked_file(frames, times, cells, {"polrep": "stokes", "pol_prim": "I", "source": "M 87*", "mjd": "57854"}))
    movie = hdf5.read_movie(spark, str(tmp_path / "a.h5"))
    rows = movie.orderBy("frame").collect()
    assert [r["frame"] for r in rows] == list(range(23)) and [r["time"] for r in rows] == times.tolist()
    assert np.array_equal(np.array([r["pix"] for r in rows]).reshape(23, 5, 7), frames.astype(float)) and {r["width"] for r in rows} == {7}
    assert json.loads(rows[0]["header"]) == {"mjd": "57854", "pol_prim": "I", "polrep": "stokes", "source": "M 87*"}
    step = max(1, 600 // 140 // cells[0]) * cells[0]
    assert len(hdf5.FramesReader({"path": str(tmp_path / "a.h5")}).partitions()) == -(-23 // step)


def test_written_movies_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(m, float(t), 4, rng.normal(size=12).tolist()) for m in (3, 5, 8) for t in rng.permutation(17)]
    frames = spark.createDataFrame(rows, "movie_id long, time double, width int, pix array<double>").repartition(5)
    done = {r["movie_id"]: r for r in hdf5.write_movies(frames, str(tmp_path / "out"), {"source": "3C 279"}).collect()}
    assert {m: r["n_frames"] for m, r in done.items()} == {3: 17, 5: 17, 8: 17}
    back = hdf5.read_movie(spark, f"file://{tmp_path}/out", "I").collect()
    got = {(int(r["file"].split("/")[-1][:-3]), r["time"]): r["pix"] for r in back}
    assert got == {(m, t): p for m, t, _, p in rows} and all(json.loads(r["header"])["source"] == "3C 279" for r in back)
    assert all(r["frame"] == r["time"] for r in back)
    assert hdf5.write_movies(frames.filter("movie_id < 0"), str(tmp_path / "none")).count() == 0


def test_images_of_simulations(tmp_path):
    """Old groups within groups, with a leaf a group and scalars."""
    rng = np.random.default_rng(3)
    data = rng.uniform(size=(6, 6, 5))
    values = {"header/dsource": 5e25, "header/scale": 2.0, "header/freqcgs": 230e9, "header/t": 7200.0, "header/units/T_unit": 0.5, "header/units/L_unit": 1e15, "header/camera/dx": 40.0, "header/camera/nx": 6.0}
    parts, at = [], 96

    def put(x):
        nonlocal at
        parts.append(x)
        at += len(x)
        return at - len(x)

    def dataset(array):
        array = np.asarray(array, "<f8")
        place = put(array.tobytes())
        return put(node_v1([(1, hdf5._space(array.shape)), (3, hdf5.DOUBLE), (8, struct.pack("<BBQQ", 3, 1, place, array.nbytes))]))

    def group(children):
        heap, entries = b"\0" * 8, b""
        for name, place in sorted(children.items()):
            entries += struct.pack("<QQI4x16x", len(heap), place, 0)
            heap += hdf5._padded(name.encode() + b"\0")
        leaf = put(b"SNOD" + struct.pack("<BxH", 1, len(children)) + entries)
        tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<QQQ", 0, leaf, 8))
        words = put(heap)
        return put(node_v1([(0x11, struct.pack("<QQ", tree, put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, words))))]))

    sub = {k: {} for k in ("", "units", "camera")}
    for path, v in values.items():
        *_, folder, name = path.split("/")
        sub["" if folder == "header" else folder][name] = dataset(v)
    head = group(sub[""] | {k: group(sub[k]) for k in ("units", "camera")})
    root = group({"header": head, "pol": dataset(data)})
    start = hdf5.SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, at, hdf5.NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
    (tmp_path / "i.h5").write_bytes(start + b"".join(parts))
    got = hdf5.read_image(str(tmp_path / "i.h5"))
    assert np.allclose(got["Q"], 2 * data[:, ::-1, 1].T) and got["time"] == 1.0 and got["freq"] == 230e9
    assert np.isclose(got["pixel"], 40 / 5e25 * 1e15 * 2.06265e11 / 6 * np.pi / 180 / 3600e6)


def test_what_is_no_movie(tmp_path):
    (tmp_path / "x").write_bytes(b"no" * 100)
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.File(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="layout version 4"):
        hdf5._layout(b"\x04\x02")
    with pytest.raises(ValueError, match="filter 9"):
        hdf5._unfiltered(b"abc", [(9, ())], 0, 4)


def test_movies_without_all_times_are_written(spark, tmp_path):
    rows = [(1, None, 2, [1.0, 2.0]), (1, 3.0, 2, [3.0, 4.0]), (1, 2.0, 2, [5.0, 6.0]), (2, 1.0, 2, [7.0, 8.0])]
    frames = spark.createDataFrame(rows, "movie_id long, time double, width int, pix array<double>")
    assert {(r["movie_id"], r["n_frames"]) for r in hdf5.write_movies(frames, str(tmp_path / "out")).collect()} == {(1, 3), (2, 1)}
    back = sorted((r["file"][-4:], r["frame"], str(r["time"]), r["pix"]) for r in hdf5.read_movie(spark, str(tmp_path / "out"), "I").collect())
    assert back == [("1.h5", 0, "nan", [1.0, 2.0]), ("1.h5", 1, "2.0", [5.0, 6.0]), ("1.h5", 2, "3.0", [3.0, 4.0]), ("2.h5", 0, "1.0", [7.0, 8.0])]


def test_a_movie_is_written_by_one_task(spark, tmp_path):
    """Its rows meet no join, after which Spark could deal a large movie to several tasks that overwrite its file."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frames = spark.range(0, 4000, 1, 8).selectExpr("if(id < 3900, 1, id % 4) movie_id", "double(id) time", "2 width", "array(double(id), rand(1), rand(2), rand(3)) pix")
        done = hdf5.write_movies(frames, str(tmp_path / "out"))
        assert "Join" not in done._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["movie_id"], r["n_frames"]) for r in done.collect()) == [(0, 25), (1, 3925), (2, 25), (3, 25)]
        back = hdf5.read_movie(spark, str(tmp_path / "out"), "I").collect()
        assert len(back) == 4000 and all(r["time"] == r["pix"][0] for r in back)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
