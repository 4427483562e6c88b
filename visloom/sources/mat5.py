"""MAT files of level 5 as a table, and tables as such files.

A file is a header and tagged elements; a compressed element is a zlib stream.  Only the first bytes of an element are unpacked for its
name and shape, and an array's values only where they are read: streams are unpacked piece by piece, without holding what is skipped.
Numbers (real, complex, logical) and texts are read; cells, structs, objects and sparse arrays are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame

from visloom.sources.arrays import Array, ArraySource, located

PIECE = 1 << 20
# Codes of the format for element types, for classes of arrays, and for flags.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
CHAR, COMPLEX, LOGICAL = 4, 8, 2


class _Stream:
    """Bytes of an element, forwards only."""

    def __init__(self, file, start: int, size: int, packed: bool):
        self.file, self.at, self.stop = file, start, start + size
        self.zip = zlib.decompressobj() if packed else None

    def read(self, n: int) -> bytes:
        return b"".join(self._pieces(n))

    def skip(self, n: int) -> None:
        if self.zip is None:
            self.at += n
        else:
            for _ in self._pieces(n):
                pass

    def finish(self) -> None:
        """To the end of a packed element, whose checksum is compared there."""
        while self.zip is not None and not self.zip.eof:
            data = self.zip.unconsumed_tail
            if not data:
                self.file.seek(self.at)
                data = self.file.read(min(PIECE, self.stop - self.at))
                self.at += len(data)
            if not data:
                raise ValueError("an element ends too early")
            self.zip.decompress(data, PIECE)

    def _pieces(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if self.zip is None:
                self.file.seek(self.at)
                piece = self.file.read(min(n, PIECE, self.stop - self.at))
                self.at += len(piece)
            else:
                data = self.zip.unconsumed_tail
                if not data:
                    self.file.seek(self.at)
                    data = self.file.read(min(PIECE, self.stop - self.at))
                    self.at += len(data)
                piece = self.zip.decompress(data, min(n, PIECE))
                if data and not piece and not self.zip.eof:
                    continue
            if not piece:
                raise ValueError("an element ends too early")
            n -= len(piece)
            yield piece


@dataclass
class _Place:
    start: int
    size: int
    packed: bool


class MatFile:
    def __init__(self, path: str):
        fs, at = located(path)
        self.file = fs.open_input_file(at)
        head = self.file.read(128)
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError(f"{path} is no MAT file of level 5")
        self.order = "<" if head[126:128] == b"IM" else ">"
        self.arrays: dict[str, Array] = {}
        self.places: dict[str, _Place] = {}
        at, end = 128, self.file.size()
        while at + 8 <= end:
            self.file.seek(at)
            kind, size = struct.unpack(self.order + "II", self.file.read(8))
            if kind in (MATRIX, COMPRESSED) and size:
                place = _Place(at + 8, size, kind == COMPRESSED)
                if (found := self._header(self._stream(place))) is not None:
                    self.arrays[found.name], self.places[found.name] = found, place
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)

    def close(self) -> None:
        self.file.close()

    def align(self, rows: int) -> int:
        return 1

    def _stream(self, place: _Place) -> _Stream:
        s = _Stream(self.file, place.start, place.size, place.packed)
        if place.packed:
            s.skip(8)  # the matrix's own tag
        return s

    def _tag(self, s: _Stream) -> tuple[int, int, bytes | None]:
        """Type, bytes, and the values where they are in the tag itself."""
        raw = s.read(8)
        kind, size = struct.unpack(self.order + "II", raw)
        if kind >> 16:
            return kind & 0xFFFF, kind >> 16, raw[4 : 4 + (kind >> 16)]
        return kind, size, None

    def _small(self, s: _Stream) -> tuple[int, bytes]:
        kind, size, own = self._tag(s)
        if own is not None:
            return kind, own
        data = s.read(size)
        s.skip(-size % 8)
        return kind, data

    def _header(self, s: _Stream) -> Array | None:
        flags = struct.unpack(self.order + "I", self._small(s)[1][:4])[0]
        shape = tuple(np.frombuffer(self._small(s)[1], self.order + "i4").tolist())
        name = self._small(s)[1].decode("ascii", "replace")
        kind, bits = flags & 0xFF, flags >> 8
        if kind == CHAR:
            return Array(name, np.dtype("u2"), shape, text=True)
        if kind not in CLASSES:
            return None
        return Array(name, np.dtype(CLASSES[kind]), shape, complex=bool(bits & COMPLEX), boolean=bool(bits & LOGICAL))

    def _part(self, s: _Stream, spans: list[tuple[int, int]]) -> tuple[np.ndarray, str]:
        """Values of the next element in these spans, which are in order; the stream ends after the element."""
        kind, size, own = self._tag(s)
        code = ELEMENTS[kind]
        step = np.dtype(code).itemsize
        if own is not None:
            data = b"".join(own[a * step : b * step] for a, b in spans)
        else:
            at, parts = 0, []
            for a, b in spans:
                s.skip(a * step - at)
                parts.append(s.read((b - a) * step))
                at = b * step
            s.skip(size - at + -size % 8)
            data = b"".join(parts)
        return np.frombuffer(data, self.order + code), code

    def read(self, name: str, first: int, stop: int) -> np.ndarray | str:
        """Rows first to stop of an array, or a text; columns of a matrix lie one after another in the file."""
        a = self.arrays[name]
        s = self._stream(self.places[name])
        self._header(s)
        if a.text:
            values, code = self._part(s, [(0, int(np.prod(a.shape)))])
            return values.astype("<u4").tobytes().decode("utf-32-le", "replace") if code != "u1" else values.tobytes().decode("utf-8", "replace")
        rows = 1 if a.single else a.longest
        wide = int(np.prod(a.shape)) // rows
        across = wide > 1 and a.shape[0] != rows  # (k, n): a row's values lie together
        spans = [(first * wide, stop * wide)] if across or wide == 1 else [(k * rows + first, k * rows + stop) for k in range(wide)]
        parts = [self._part(s, spans)[0].astype(a.dtype)]
        if a.complex:
            parts.append(self._part(s, spans)[0].astype(a.dtype))
        s.finish()
        z = parts[0] + 1j * parts[1] if a.complex else parts[0]
        if wide == 1:
            return z
        return z.reshape(-1, wide) if across else z.reshape(wide, -1).T


class MatSource(ArraySource):
    suffix = ".mat"

    @classmethod
    def name(cls) -> str:
        return "mat5"

    @staticmethod
    def opened(path: str, options: dict[str, str] = {}) -> MatFile:
        return MatFile(path)


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def encode(arrays: dict[str, np.ndarray | str], packed: bool = True) -> bytes:
    """A MAT file of these arrays (one-dimensional ones become columns) and texts."""
    codes, classes = {v: k for k, v in list(ELEMENTS.items())[:10]}, {v: k for k, v in CLASSES.items()}
    out = [b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in arrays.items():
        if isinstance(value, str):
            flags, shape, parts = CHAR, (1, len(value)), [_element(4, value.encode("utf-16-le"))]
        else:
            value = np.asarray(value)
            boolean, part = value.dtype == bool, value.real.dtype
            code = "u1" if boolean else part.str[1:]
            flags = classes[code] | (LOGICAL << 8 if boolean else 0) | (COMPLEX << 8 if np.iscomplexobj(value) else 0)
            shape = (value.size, 1) if value.ndim < 2 else value.shape
            pieces = [value.real, value.imag] if np.iscomplexobj(value) else [value]
            parts = [_element(codes[code], np.asarray(p).astype("<" + code).tobytes(order="F")) for p in pieces]
        body = _element(6, struct.pack("<II", flags, 0)) + _element(5, struct.pack(f"<{len(shape)}i", *shape)) + _element(1, name.encode()) + b"".join(parts)
        matrix = struct.pack("<II", MATRIX, len(body)) + body
        if packed:
            body = zlib.compress(matrix)
            matrix = struct.pack("<II", COMPRESSED, len(body)) + body
        out.append(matrix)
    return b"".join(out)


def files_of(rows: DataFrame, key: str, prefix: str, most: int = 500_000) -> DataFrame:
    """(name, content): MAT files of up to ``most`` rows of one value of ``key`` each; every task makes files of its own rows.

    Columns are numbers, booleans, or structs of re and im; a null number is NaN.  A name is the prefix, the key, and a hash of the content.
    """
    names = [c for c in rows.columns if c != key]
    kind = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "double": "f8", "float": "f4"}[dict(rows.dtypes)[key]]

    def of(column: pa.Array) -> np.ndarray:
        if pa.types.is_struct(column.type):
            return of(column.field("re")) + 1j * of(column.field("im"))
        return column.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[pa.Table]] = {}

        def made(k: object) -> pa.RecordBatch:
            t = pa.concat_tables(held.pop(k)).combine_chunks()
            content = encode({key: np.array([k], kind), **{c: of(t.column(c).chunk(0)) for c in names}})
            return pa.RecordBatch.from_pydict({"name": [f"{prefix}_{key}_{k}_{zlib.crc32(content):08x}.mat"], "content": [content]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

        for b in batches:
            t = pa.Table.from_batches([b])
            for k in t.column(key).unique().to_pylist():
                held.setdefault(k, []).append(t.filter(pa.compute.equal(t.column(key), k)).drop_columns([key]))
                if sum(x.num_rows for x in held[k]) >= most:
                    yield made(k)
        for k in list(held):
            yield made(k)

    return rows.mapInArrow(run, "name string, content binary")
