"""HDF5 files made by an encoder of the test's own, read back through Spark."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.sources import arrays, hdf5

NONE = (1 << 64) - 1


def pad(b):
    return b + b"\0" * (-len(b) % 8)


def dtype_message(dt):
    dt = np.dtype(dt)
    if dt.names:
        body = b""
        for n in dt.names:
            inner, at = dt.fields[n]
            body += pad(n.encode() + b"\0") + struct.pack("<IB3xI4x16x", at, 0, 0) + dtype_message(inner)
        return struct.pack("<B", 0x16) + len(dt.names).to_bytes(3, "little") + struct.pack("<I", dt.itemsize) + body
    big = 1 if dt.byteorder == ">" else 0
    if dt.kind == "f":
        e, m, bias = (11, 52, 1023) if dt.itemsize == 8 else (8, 23, 127)
        return struct.pack("<B3BI", 0x11, 0x20 | big, dt.itemsize * 8 - 1, 0, dt.itemsize) + struct.pack("<HHBBBBI", 0, dt.itemsize * 8, m, e, 0, m, bias)
    if dt.kind == "S":
        return struct.pack("<B3BI", 0x13, 0, 0, 0, dt.itemsize)
    if dt.kind == "b":
        names = pad(b"FALSE\0") + pad(b"TRUE\0")
        return struct.pack("<B3BI", 0x18, 2, 0, 0, 1) + dtype_message("i1") + names + b"\0\1"
    return struct.pack("<B3BI", 0x10, (8 if dt.kind == "i" else 0) | big, 0, 0, dt.itemsize) + struct.pack("<HH", 0, dt.itemsize * 8)


class File:
    """Superblock of version 0, old-style headers and groups; addresses count from the end of a block of the user's."""

    def __init__(self, before=0):
        self.buf, self.before = bytearray(96), before

    def put(self, data):
        at = len(self.buf)
        self.buf += pad(data)
        return at

    def header(self, messages, split=False):
        make = lambda ms: b"".join(struct.pack("<HHB3x", k, len(pad(d)), 0) + pad(d) for k, d in ms)
        if split:  # all but the first message in a continuation block
            rest = make(messages[1:])
            at = self.put(rest)
            messages = [messages[0], (0x10, struct.pack("<QQ", at, len(rest)))]
        body = make(messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def dataset(self, a, chunk=None, filters=(), split=False, fanout=3, skip=()):
        a = np.asarray(a)
        space = struct.pack("<BBB5x", 1, a.ndim, 0) + struct.pack(f"<{a.ndim}Q", *a.shape)
        messages = [(1, space), (3, dtype_message(a.dtype))]
        if chunk is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes)))
        elif chunk == "compact":
            messages.append((8, struct.pack("<BBH", 3, 0, a.nbytes) + a.tobytes()))
        else:
            leaves = []
            for place in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunk)]):
                if place in skip:
                    continue
                at = [p * c for p, c in zip(place, chunk)]
                full = np.zeros(chunk, a.dtype)
                part = a[tuple(slice(p, p + c) for p, c in zip(at, chunk))]
                full[tuple(slice(0, n) for n in part.shape)] = part
                raw = full.tobytes()
                for f in filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.itemsize).T.tobytes() if f == 2 else zlib.compress(raw) if f == 1 else raw + b"sum!"
                leaves.append((struct.pack("<II", len(raw), 0) + struct.pack(f"<{a.ndim + 1}Q", *at, 0), self.put(raw)))
            last = struct.pack("<II", 0, 0) + struct.pack(f"<{a.ndim + 1}Q", *[-(-n // c) * c for n, c in zip(a.shape, chunk)], 0)
            level, nodes = 0, leaves
            while level == 0 or len(nodes) > 1:
                up = []
                for i in range(0, len(nodes), fanout):
                    group = nodes[i : i + fanout]
                    end = nodes[i + fanout][0] if i + fanout < len(nodes) else last
                    body = b"".join(k + struct.pack("<Q", c) for k, c in group) + end
                    up.append((group[0][0], self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(group), NONE, NONE) + body)))
                level, nodes = level + 1, up
            messages.append((8, struct.pack("<BBBQ", 3, 2, a.ndim + 1, nodes[0][1]) + struct.pack(f"<{a.ndim + 1}I", *chunk, a.itemsize)))
            if filters:
                body = b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", a.itemsize, 0) for f in filters)
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + body))
        return self.header(messages, split)

    def group(self, links, per_node=2):
        names, offsets = b"\0" * 8, {}
        for n in sorted(links):
            offsets[n] = len(names)
            names += pad(n.encode() + b"\0")
        data = self.put(names)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NONE, data))
        order, nodes = sorted(links), []
        for i in range(0, len(order), per_node):
            part = order[i : i + per_node]
            body = b"".join(struct.pack("<QQI4x16x", offsets[n], links[n], 0) for n in part)
            nodes.append((offsets[part[-1]], self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + body)))
        body = struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", c, k) for k, c in nodes)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NONE, NONE) + body)
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def bytes(self, root):
        head = hdf5.SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", self.before, NONE, len(self.buf), NONE) + struct.pack("<QQI4x16x", 0, root, 0)
        self.buf[: len(head)] = head
        return b"\0" * self.before + bytes(self.buf)


N = 1003


def tables(seed=0):
    rng = np.random.default_rng(seed)
    y = np.zeros(N, [("real", "<f8"), ("imag", "<f8")])
    y["real"], y["imag"] = rng.normal(size=(2, N))
    return y, rng.normal(size=(N, 3)), rng.integers(0, 2, N).astype(bool), rng.integers(-9, 9, (2, N)).astype(">i4")


@pytest.mark.parametrize("before", [0, 512])
def test_read_equals_what_was_written(spark, tmp_path, before):
    y, uvw, flag, pair = tables()
    f = File(before)
    inner = f.group({"y": f.dataset(y, (100,), (2, 1, 3), split=True), "nw": f.dataset(uvw[:, 0].astype("<f4"), (64,), skip={(2,)}), "one": f.dataset(np.array([[7]], "<i8"))})
    root = f.group({
        "uvw": f.dataset(uvw, (90, 2), (1,)), "flag": f.dataset(flag), "pair": f.dataset(pair, (1, 128)), "name": f.dataset(np.array([b"target"]), "compact"),
        "freq": f.dataset(np.array([1.4e9]), "compact"), "freqs": f.dataset(np.arange(5.0)), "ch": inner,
    })
    (tmp_path / "a.h5").write_bytes(f.bytes(root))
    df = arrays.table(spark, hdf5.HdfSource, str(tmp_path / "a.h5"), rowsPerPartition=150)
    assert set(df.columns) == {"path", "row", "uvw", "flag", "pair", "name", "freq", "ch"} and set(df.select("ch.*").columns) == {"y", "nw", "one"}
    assert df.rdd.getNumPartitions() == 4  # 150 rows, rounded up to whole chunks of 128
    rows = sorted(df.collect(), key=lambda r: r["row"])
    assert np.array_equal([r["ch"]["y"]["re"] for r in rows], y["real"]) and np.array_equal([r["ch"]["y"]["im"] for r in rows], y["imag"])
    nw = uvw[:, 0].astype("<f4")
    nw[128:192] = 0  # a chunk that was never written
    assert np.array_equal([r["ch"]["nw"] for r in rows], nw) and {(r["name"], r["freq"], r["ch"]["one"]) for r in rows} == {("target", 1.4e9, 7)}
    assert np.array_equal([r["uvw"] for r in rows], uvw) and [r["flag"] for r in rows] == flag.tolist() and np.array_equal([r["pair"] for r in rows], pair.T)
    own = arrays.table(spark, hdf5.HdfSource, str(tmp_path), columns=["y"], group="/ch")
    assert own.select(F.sum("y.im")).first()[0] == pytest.approx(y["imag"].sum())
    assert sorted(r[0] for r in arrays.table(spark, hdf5.HdfSource, str(tmp_path), columns=["freqs"], rows="freqs").collect()) == [0, 1, 2, 3, 4]


def test_only_chunks_of_the_range_are_read(tmp_path):
    """A chunk that is broken is no trouble to the rows of the others."""
    y, *_ = tables()
    f = File()
    root = f.group({"y": f.dataset(y, (100,), (1,))})
    raw = bytearray(f.bytes(root))
    broken = zlib.compress(y[500:600].tobytes())
    at = raw.index(broken)
    raw[at : at + 40] = bytes(40)
    (tmp_path / "a.h5").write_bytes(raw)
    h = hdf5.HdfFile(str(tmp_path / "a.h5"))
    for a, b in ((0, 500), (600, N), (450, 500)):
        assert np.array_equal(h.read("y", a, b), y["real"][a:b] + 1j * y["imag"][a:b])
    with pytest.raises(zlib.error):
        h.read("y", 480, 520)


def test_other_files(tmp_path):
    (tmp_path / "x.h5").write_bytes(b"no" * 1000)
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.HdfFile(str(tmp_path / "x.h5"))
    f = File()
    (tmp_path / "g.h5").write_bytes(f.bytes(f.group({"a": f.dataset(np.arange(3))})))
    with pytest.raises(ValueError, match="no group"):
        hdf5.HdfFile(str(tmp_path / "g.h5"), "/b")
