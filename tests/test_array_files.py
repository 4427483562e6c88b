"""MAT files and named files: round trips, pruning, ranges, and commits that are all or none."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.sources import arrays, fits, mat5, sink


def element(order, kind, data, small=False):
    if small:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(order, name, flags, shape, parts, small=False):
    body = element(order, 6, struct.pack(order + "II", flags, 0)) + element(order, 5, struct.pack(f"{order}{len(shape)}i", *shape))
    return element(order, 14, body + element(order, 1, name, small) + b"".join(parts))


def mat(order, *matrices, packed=()):
    mark = struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    out = b"made by a test".ljust(116) + b"\0" * 8 + mark
    for i, m in enumerate(matrices):
        z = zlib.compress(m)
        out += struct.pack(order + "II", 15, len(z)) + z if i in packed else m
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_of_a_plain_encoder(spark, tmp_path, order):
    """Big and little endian, packed or not, values stored in a smaller type, in the tag, and in columns."""
    n = 1000
    rng = np.random.default_rng(0)
    y, uvw, flag = rng.normal(size=(n, 2)) @ [1, 1j], rng.normal(size=(n, 3)), rng.integers(0, 2, n)
    file = mat(
        order,
        matrix(order, b"y", 6 | 8 << 8, (n, 1), [element(order, 9, y.real.astype(order + "f8").tobytes()), element(order, 9, y.imag.astype(order + "f8").tobytes())], small=True),
        matrix(order, b"uvw", 6, (n, 3), [element(order, 9, uvw.astype(order + "f8").tobytes(order="F"))]),
        matrix(order, b"flag", 9 | 2 << 8, (1, n), [element(order, 2, flag.astype("u1").tobytes())]),
        matrix(order, b"frequency", 6, (1, 1), [element(order, 4, struct.pack(order + "H", 1400), small=True)]),
        matrix(order, b"title", 4, (1, 3), [element(order, 4, "aé!".encode("utf-16-le" if order == "<" else "utf-16-be"))]),
        matrix(order, b"freqs", 6, (1, 7), [element(order, 9, np.arange(7).astype(order + "f8").tobytes())]),
        matrix(order, b"other", 2, (1, 1), [element(order, 5, b"")]),
        packed=(0, 1, 4),
    )
    (tmp_path / "a.mat").write_bytes(file)
    df = arrays.table(spark, mat5.MatSource, str(tmp_path), rowsPerPartition=301)
    assert df.columns == ["path", "row", "y", "uvw", "flag", "frequency", "title"] and df.rdd.getNumPartitions() == 4
    rows = sorted(df.collect(), key=lambda r: r["row"])
    assert np.array_equal([r["y"]["re"] + 1j * r["y"]["im"] for r in rows], y) and np.array_equal([r["uvw"] for r in rows], uvw)
    assert [r["flag"] for r in rows] == flag.astype(bool).tolist() and {(r["frequency"], r["title"]) for r in rows} == {(1400.0, "aé!")}
    own = arrays.table(spark, mat5.MatSource, f"file://{tmp_path}/*.mat", columns=["freqs", "row"], rows="freqs")
    assert sorted(tuple(r) for r in own.collect()) == [(float(i), i) for i in range(7)]


def test_unread_arrays_are_not_unpacked(spark, tmp_path):
    """The packed values of an array that is not asked for are broken; reading the others does not notice."""
    noise = np.random.default_rng(1).normal(size=5000)
    good, bad = matrix("<", b"u", 6, (5000, 1), [element("<", 9, noise.tobytes())]), matrix("<", b"v", 6, (5000, 1), [element("<", 9, noise.tobytes())])
    z = bytearray(zlib.compress(bad))
    z[len(z) // 2 :] = bytes(len(z) - len(z) // 2)
    file = mat("<", good, packed=(0,)) + struct.pack("<II", 15, len(z)) + bytes(z)
    (tmp_path / "a.mat").write_bytes(file)
    df = arrays.table(spark, mat5.MatSource, str(tmp_path / "a.mat"), columns=["u"])
    assert df.agg(F.sum("u")).first()[0] == pytest.approx(noise.sum())
    with pytest.raises(Exception, match="invalid|early|Error"):
        arrays.table(spark, mat5.MatSource, str(tmp_path / "a.mat"), columns=["v"]).collect()


def test_tables_to_files_and_back(spark, tmp_path):
    rows = [(i, i % 3, float(i) / 7, (i * 0.5, -i * 0.25), i % 2 == 0, None if i % 5 else 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ch int, u double, y struct<re: double, im: double>, flagged boolean, nw double").repartition(3)
    files = mat5.files_of(df, "ch", "chan", most=40)
    sink.write_files(files, str(tmp_path / "out"), prefix="run_")
    names = os.listdir(tmp_path / "out")
    assert len(names) >= 6 and all(n.startswith("run_chan_ch_") and n.endswith(".mat") for n in names)
    back = arrays.table(spark, mat5.MatSource, str(tmp_path / "out")).drop("path", "row")
    got = sorted((r["id"], r["ch"], r["u"], tuple(r["y"]), r["flagged"], None if np.isnan(r["nw"]) else r["nw"]) for r in back.collect())
    assert got == rows


def test_no_mat_file(spark, tmp_path):
    with pytest.raises(Exception, match="no .mat file"):
        arrays.table(spark, mat5.MatSource, str(tmp_path / "none"), columns=["u"])
    (tmp_path / "b.mat").write_bytes(b"x" * 200)
    with pytest.raises(ValueError, match="level 5"):
        mat5.MatFile(str(tmp_path / "b.mat"))
    (tmp_path / "e.mat").write_bytes(mat("<"))
    assert arrays.table(spark, mat5.MatSource, str(tmp_path / "e.mat")).count() == 0


def test_commit_is_all_or_none(spark, tmp_path):
    out = str(tmp_path / "files")
    df = spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"2"), ("c.bin", None)], "name string, content binary").repartition(3)
    sink.write_files(df, out)
    read = lambda: {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)}
    assert read() == {"a.bin": b"1", "b.bin": b"2", "c.bin": b""}
    more = spark.createDataFrame([("a.bin", b"9"), ("d.bin", b"9")], "name string, content binary")
    with pytest.raises(Exception, match="already"):
        sink.write_files(more, out)
    assert read() == {"a.bin": b"1", "b.bin": b"2", "c.bin": b""}
    sink.write_files(more, out, overwrite=True)
    assert read() == {"a.bin": b"9", "b.bin": b"2", "c.bin": b"", "d.bin": b"9"}
    bad = spark.createDataFrame([("e.bin", b"1"), ("../f", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="no file name"):
        sink.write_files(bad, out)
    with pytest.raises(Exception, match="one name"):
        sink.write_files(spark.createDataFrame([("g", b"1"), ("g", b"2")], "name string, content binary"), out)
    assert sorted(read()) == ["a.bin", "b.bin", "c.bin", "d.bin"]


def test_images_as_files(spark, tmp_path):
    rows = [(f"i{k}.fits", y, x, float(k + y * 4 + x)) for k in range(3) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "path string, y int, x int, v double").repartition(4)
    fits.write_images(df, str(tmp_path / "img"), prefix="run_")
    back = fits.read_images(spark, f"file://{tmp_path}/img/*.fits")
    got = sorted((os.path.basename(r["path"]).removeprefix("run_"), r["y"], r["x"], r["v"]) for r in back.collect())
    assert got == rows
