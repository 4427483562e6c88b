"""HDF5 files as a table: arrays of a group and of the groups in it.

The reader walks superblock, object headers, symbol tables and the trees of chunks itself.  A range of rows reads only the chunks that
overlap it, and partitions start at chunks, so one large file is many tasks.  Numbers, flags, fixed-length texts and complex pairs
(compounds of real and imag, or r and i) are read; other types are left out.  Arrays of a group inside the group are fields of a
struct of its name.  Compact, contiguous and chunked storage with deflate, shuffle and checksum filters is known; the layouts and groups that
only the latest versions of the format write (chunk indexes other than trees, dense links) are an error where they are met.

Options: ``group`` (default the root), and those of ``arrays``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from visloom.sources.arrays import Array, ArraySource, located

# Signatures, message types and filter numbers of the format, and the address that means none.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, DATATYPE, LINK_INFO, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x01, 0x03, 0x02, 0x06, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
NOWHERE = (1 << 64) - 1


@dataclass
class _Dataset:
    shape: tuple[int, ...]
    dtype: np.dtype
    layout: tuple  # ("compact", bytes), ("contiguous", address) or ("chunked", address of the tree, chunk's shape)
    filters: list[tuple[int, list[int]]] = field(default_factory=list)


def _datatype(raw: bytes) -> tuple[np.dtype | None, int, str]:
    """(type, bytes used, what it stands for: a number, "bool", "text", or "" where it is not known)."""
    kind, version, bits, size = raw[0] & 15, raw[0] >> 4, int.from_bytes(raw[1:4], "little"), struct.unpack_from("<I", raw, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), 12, "number"
    if kind == 1:
        return np.dtype(f"{order}f{size}"), 20, "number"
    if kind == 3:
        return np.dtype(f"S{size}"), 8, "text"
    if kind == 8:
        base, used, _ = _datatype(raw[8:])
        at, names = 8 + used, []
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", at)
            names.append(raw[at:end].decode().upper())
            at = end + 1 if version >= 3 else at + (end - at) // 8 * 8 + 8
        return base, at + base.itemsize * len(names), "bool" if names == ["FALSE", "TRUE"] else "number"
    if kind == 6:
        at, names, formats, places = 8, [], [], []
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", at)
            names.append(raw[at:end].decode())
            at = end + 1 if version >= 3 else at + (end - at) // 8 * 8 + 8
            if version >= 3:
                wide = max(1, (size.bit_length() + 7) // 8)
                places.append(int.from_bytes(raw[at : at + wide], "little"))
                at += wide
            else:
                places.append(struct.unpack_from("<I", raw, at)[0])
                at += 4 + (28 if version == 1 else 0)
            inner, used, what = _datatype(raw[at:])
            if inner is None or what != "number":
                return None, 0, ""
            formats.append(inner)
            at += used
        return np.dtype({"names": names, "formats": formats, "offsets": places, "itemsize": size}), at, "compound"
    return None, 0, ""


class HdfFile:
    def __init__(self, path: str, group: str = "/"):
        fs, at = located(path)
        self.file = fs.open_input_file(at)
        self.base, end, at = 0, self.file.size(), 0
        while self._at(at, 8) != SIGNATURE:  # a block of the user's may come first
            at = at * 2 or 512
            if at >= end:
                raise ValueError(f"{path} is no HDF5 file")
        version = self._at(at + 8, 1)[0]
        if version < 2:
            sizes, start = self._at(at + 13, 2), at + (24 if version == 0 else 28)
            root = start + 40  # the header's address in the root's entry
        else:
            sizes, start = self._at(at + 9, 2), at + 12
            root = start + 24
        if sizes != b"\x08\x08":
            raise ValueError("addresses and lengths of 8 bytes are read")
        header = self._number(root)
        self.base = self._number(start)
        for name in filter(None, group.split("/")):
            links = dict(self._links(header))
            if name not in links:
                raise ValueError(f"no group {group!r} in {path}")
            header = links[name]
        self.arrays: dict[str, Array] = {}
        self.sets: dict[str, _Dataset] = {}
        for name, address in self._links(header):
            if not self._add(name, address):
                for inner, below in self._links(address):
                    self._add(f"{name}/{inner}", below)

    def close(self) -> None:
        self.file.close()

    def _at(self, address: int, n: int) -> bytes:
        self.file.seek(self.base + address)
        return self.file.read(n)

    def _number(self, address: int) -> int:
        return int.from_bytes(self._at(address, 8), "little")

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self._at(address, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            at = address + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            wide = 1 << (flags & 3)
            blocks = [(at + wide, int.from_bytes(self._at(at, wide), "little"))]
            lead, ordered = 4, 2 if flags & 4 else 0
        else:
            blocks, lead, ordered = [(address + 16, struct.unpack_from("<I", head, 8)[0])], 8, 0
        while blocks:
            start, size = blocks.pop(0)
            raw, at = self._at(start, size), 0
            while at + lead <= len(raw):
                kind, n = (raw[at], struct.unpack_from("<H", raw, at + 1)[0]) if lead == 4 else struct.unpack_from("<HH", raw, at)
                at += lead + ordered
                data = raw[at : at + n]
                at += n
                if kind == CONTINUATION:
                    where, many = struct.unpack("<QQ", data[:16])
                    blocks.append((where + 4, many - 8) if lead == 4 else (where, many))
                else:
                    yield kind, data

    def _links(self, address: int) -> Iterator[tuple[str, int]]:
        for kind, data in self._messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", data[:16])
                names = self._number(heap + 24)
                for node in self._nodes(tree):
                    many = struct.unpack("<H", self._at(node + 6, 2))[0]
                    for i in range(many):
                        name, header = struct.unpack("<QQ", self._at(node + 8 + 40 * i, 16))
                        yield self._text(names + name), header
            elif kind == LINK:
                flags, at = data[1], 2 + (1 if data[1] & 8 else 0) + (8 if data[1] & 4 else 0) + (1 if data[1] & 16 else 0)
                wide = 1 << (flags & 3)
                n = int.from_bytes(data[at : at + wide], "little")
                if not flags & 8 or data[2] == 0:  # a hard link
                    yield data[at + wide : at + wide + n].decode(), int.from_bytes(data[at + wide + n : at + wide + n + 8], "little")
            elif kind == LINK_INFO and int.from_bytes(data[-16 if not data[1] & 2 else -24 :][:8], "little") != NOWHERE:
                raise ValueError("groups with dense links are not read")

    def _text(self, address: int) -> str:
        out = b""
        while b"\0" not in out:
            piece = self._at(address + len(out), 64)
            if not piece:
                raise ValueError("a name ends too early")
            out += piece
        return out[: out.index(b"\0")].decode()

    def _nodes(self, address: int) -> Iterator[int]:
        """Symbol nodes below a node of a group's tree."""
        head = self._at(address, 24)
        level, many = head[5], struct.unpack_from("<H", head, 6)[0]
        body = struct.unpack(f"<{2 * many}Q", self._at(address + 24, 16 * many))
        for child in body[1::2]:
            yield from self._nodes(child) if level else [child]

    def _add(self, name: str, address: int) -> bool:
        """Take a dataset up; False if there is none at this address."""
        found = dict((k, d) for k, d in self._messages(address) if k in (DATASPACE, DATATYPE, LAYOUT, FILTERS))
        if LAYOUT not in found:
            return False
        space, layout = found[DATASPACE], found[LAYOUT]
        first = 8 if space[0] == 1 else 4
        shape = struct.unpack_from(f"<{space[1]}Q", space, first)
        dtype, _, what = _datatype(found[DATATYPE])
        pair = what == "compound" and tuple(dtype.names) in (("real", "imag"), ("r", "i"))
        if dtype is None or what == "compound" and not pair:
            return True
        if layout[0] != 3:
            raise ValueError(f"the layout of {name} is not read")
        if layout[1] == 0:
            place = ("compact", layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]])
        elif layout[1] == 1:
            place = ("contiguous", struct.unpack_from("<Q", layout, 2)[0])
        else:
            rank = layout[2] - 1
            place = ("chunked", struct.unpack_from("<Q", layout, 3)[0], struct.unpack_from(f"<{rank}I", layout, 11))
        self.sets[name] = _Dataset(shape, dtype, place, self._filters(found.get(FILTERS)))
        part = dtype.fields[dtype.names[0]][0] if pair else dtype
        self.arrays[name] = Array(name, np.dtype("u1") if what == "text" else part.newbyteorder("<") if part.itemsize > 1 else part, shape, complex=pair, boolean=what == "bool", text=what == "text")
        return True

    @staticmethod
    def _filters(raw: bytes | None) -> list[tuple[int, list[int]]]:
        out: list[tuple[int, list[int]]] = []
        if not raw:
            return out
        old, at = raw[0] == 1, 8 if raw[0] == 1 else 2
        for _ in range(raw[1]):
            kind = struct.unpack_from("<H", raw, at)[0]
            named = old or kind >= 256
            length = struct.unpack_from("<H", raw, at + 2)[0] if named else 0
            _, many = struct.unpack_from("<HH", raw, at + (4 if named else 2))
            at += (8 if named else 6) + (length + (-length % 8 if old else 0))
            out.append((kind, list(struct.unpack_from(f"<{many}I", raw, at))))
            at += 4 * (many + (many % 2 if old else 0))
        return out

    def align(self, rows: int) -> int:
        """Rows of the largest chunk, so that partitions share none."""
        found = [d.layout[2][d.shape.index(rows)] for d in self.sets.values() if d.layout[0] == "chunked" and rows in d.shape]
        return max(found, default=1)

    def _chunks(self, tree: int, rank: int, axis: int, first: int, stop: int, deep: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(place, address, bytes, filter mask) of the chunks that overlap rows first to stop of an axis."""
        head = self._at(tree, 24)
        level, many = head[5], struct.unpack_from("<H", head, 6)[0]
        step = 8 + 8 * (rank + 1) + 8
        raw = self._at(tree + 24, step * many + step - 8)
        for i in range(many):
            size, mask, *place = struct.unpack_from(f"<II{rank}Q", raw, i * step)
            following = struct.unpack_from(f"<II{rank}Q", raw, (i + 1) * step)[2:]
            if level:
                # places are in order of the first axis, so a subtree has places from its key's on to the next key's
                if axis or (place[0] < stop and following[0] + deep > first):
                    yield from self._chunks(struct.unpack_from("<Q", raw, (i + 1) * step - 8)[0], rank, axis, first, stop, deep)
            elif place[axis] < stop and place[axis] + deep > first:
                yield tuple(place), struct.unpack_from("<Q", raw, (i + 1) * step - 8)[0], size, mask

    @staticmethod
    def _unpacked(raw: bytes, filters: list[tuple[int, list[int]]], mask: int) -> bytes:
        for i, (kind, values) in reversed(list(enumerate(filters))):
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == FLETCHER:
                raw = raw[:-4]
            elif kind == SHUFFLE:
                wide = values[0]
                whole = len(raw) // wide * wide
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(wide, -1).T.tobytes() + raw[whole:]
            else:
                raise ValueError(f"filter {kind} is not known")
        return raw

    def read(self, name: str, first: int, stop: int) -> np.ndarray | str:
        """Rows first to stop of an array, or a text."""
        a, d = self.arrays[name], self.sets[name]
        if a.single:
            z = self._span(d, 0, 0, d.shape[0] if d.shape else 1).reshape(-1)[:1]
        else:
            axis = d.shape.index(a.longest)
            z = np.moveaxis(self._span(d, axis, first, stop), axis, 0).reshape(stop - first, -1)
        if a.text:
            return z[0].decode("utf-8", "replace") if len(z) else ""
        if a.complex:
            re, im = (z[n].astype(a.dtype) for n in d.dtype.names)
            z = re + 1j * im
        else:
            z = z.astype(a.dtype)
        return z if z.ndim == 1 or z.shape[1] > 1 else z[:, 0]

    def _span(self, d: _Dataset, axis: int, first: int, stop: int) -> np.ndarray:
        shape = tuple(stop - first if i == axis else n for i, n in enumerate(d.shape))
        cut = tuple(slice(first, stop) if i == axis else slice(None) for i in range(len(shape)))
        if d.layout[0] == "compact":
            return np.frombuffer(d.layout[1], d.dtype, int(np.prod(d.shape))).reshape(d.shape)[cut]
        out = np.zeros(shape, d.dtype)
        if d.layout[1] == NOWHERE or not out.size:
            return out
        if d.layout[0] == "contiguous":
            wide = int(np.prod(d.shape[1:])) * d.dtype.itemsize
            low, high = (first, stop) if axis == 0 and d.shape else (0, d.shape[0] if d.shape else 1)
            raw = np.frombuffer(self._at(d.layout[1] + low * wide, (high - low) * wide), d.dtype)
            return raw.reshape(shape) if axis == 0 else raw.reshape(d.shape)[cut]
        _, tree, chunk = d.layout
        for place, address, size, mask in self._chunks(tree, len(chunk), axis, first, stop, chunk[axis]):
            part = np.frombuffer(self._unpacked(self._at(address, size), d.filters, mask), d.dtype, int(np.prod(chunk))).reshape(chunk)
            into, of = [], []
            for i, (p, c, n) in enumerate(zip(place, chunk, d.shape)):
                low, high = (max(p, first), min(p + c, stop)) if i == axis else (p, min(p + c, n))
                into.append(slice(low - (first if i == axis else 0), high - (first if i == axis else 0)))
                of.append(slice(low - p, high - p))
            out[tuple(into)] = part[tuple(of)]
        return out


class HdfSource(ArraySource):
    suffix = ".h5"

    @classmethod
    def name(cls) -> str:
        return "hdf5_arrays"

    @staticmethod
    def opened(path: str, options: dict[str, str] = {}) -> HdfFile:
        return HdfFile(path, options.get("group", "/"))
