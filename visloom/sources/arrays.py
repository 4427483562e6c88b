"""Files that hold named arrays, as tables: what the readers of such formats share.

A file's table has one row for each place of its longest array (or of the array that the option ``rows`` names).  Arrays of that
length are columns, two-dimensional ones array columns; single values and texts are the same in every row; other arrays are left out.
Complex values are structs of re and im.  ``path`` and ``row`` (place from 0 on) can be read as well.

Partitions are ranges of ``rowsPerPartition`` rows of a file, so one large file is several tasks.  Spark hands a Python source no list
of used columns; a schema of fewer columns (``table`` builds it) keeps the others from being read at all.

Files are opened by pyarrow's file systems: local and shared folders, and the stores that it knows by URI.  ``load`` takes a file, a folder,
or a pattern in the last part of a path.  The schema comes from the first file; a column that a later file lacks is null there.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 50_000


@dataclass(frozen=True)
class Array:
    """What a file's header says of one array."""

    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    complex: bool = False
    boolean: bool = False
    text: bool = False

    @property
    def longest(self) -> int:
        return max(self.shape, default=1)

    @property
    def single(self) -> bool:
        return self.text or int(np.prod(self.shape)) == 1

    def width(self, rows: int) -> int | None:
        """Values a row if this is a column of a table of so many rows."""
        size = int(np.prod(self.shape))
        return 1 if self.single else size // rows if rows in self.shape and sum(s > 1 for s in self.shape) <= 2 else None


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):  # as Hadoop writes it
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[str]:
    """The files that a path, folder or pattern names, in order."""
    fs, at = located(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch.fnmatchcase(f.base_name, last)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            found = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name.endswith(suffix)]
        else:
            found = [at] if info.is_file else []
    if not found:
        raise FileNotFoundError(f"no {suffix} file at {path}")
    return [prefix + f for f in sorted(found)]


_TYPES = {"f8": T.DoubleType(), "f4": T.FloatType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.LongType()}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    plain = {"double": pa.float64(), "float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return plain[kind.simpleString()]


def _type(a: Array, rows: int) -> T.DataType | None:
    width = a.width(rows)
    if width is None:
        return None
    kind: T.DataType = T.StringType() if a.text else T.BooleanType() if a.boolean else _TYPES[a.dtype.str[1:]]
    if a.complex:
        kind = T.StructType([T.StructField("re", kind), T.StructField("im", kind)])
    return T.ArrayType(kind) if width > 1 else kind


@dataclass
class Range(InputPartition):
    path: str
    first: int
    stop: int


class ArraySource(DataSource):
    """A format of named arrays; a subclass opens a file (``opened``) and has a name and a suffix."""

    suffix = ""

    @staticmethod
    def opened(path: str, options: dict[str, str] = {}):
        """An object with ``arrays`` (name to Array), ``read(name, first, stop)``, rows first, and ``align(rows)``; closed by ``close``."""
        raise NotImplementedError

    def schema(self) -> T.StructType:
        f = self.opened(listed(self.options["path"], self.suffix)[0], self.options)
        try:
            rows = rows_of(f.arrays, self.options.get("rows"))
            fields = [(k, _type(a, rows)) for k, a in f.arrays.items()]
        finally:
            f.close()
        own = [T.StructField(k, t) for k, t in fields if t is not None]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *nested(own)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(type(self), schema, dict(self.options))


def nested(fields: list[T.StructField]) -> list[T.StructField]:
    """Names of two parts, as of an array in a group of a file, become fields of a struct."""
    out: dict[str, T.StructField] = {}
    for f in fields:
        group, _, name = f.name.partition("/")
        if not name:
            out[f.name] = f
        else:
            inner = out[group].dataType.fields if group in out and isinstance(out[group].dataType, T.StructType) else []
            out[group] = T.StructField(group, T.StructType([*inner, T.StructField(name, f.dataType)]))
    return list(out.values())


def rows_of(arrays: dict[str, Array], named: str | None) -> int:
    if named and named not in arrays:
        raise ValueError(f"no array {named!r}")
    return arrays[named].longest if named else max((a.longest for a in arrays.values() if not a.text), default=0)


class ArrayReader(DataSourceReader):
    def __init__(self, source: type[ArraySource], schema: T.StructType, options: dict[str, str]):
        self.source, self.fields, self.options = source, schema, options

    def partitions(self) -> list[InputPartition]:
        step = int({k.lower(): v for k, v in self.options.items()}.get("rowsperpartition", 1_000_000))
        out: list[InputPartition] = []
        for path in listed(self.options["path"], self.source.suffix):
            f = self.source.opened(path, self.options)
            try:
                rows = rows_of(f.arrays, self.options.get("rows"))
                least = f.align(rows)
            finally:
                f.close()
            wide = -(-step // least) * least
            out += [Range(path, i, min(rows, i + wide)) for i in range(0, rows, wide)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows in any file
            return
        f = self.source.opened(part.path, self.options)
        try:
            rows = rows_of(f.arrays, self.options.get("rows"))
            n = part.stop - part.first
            columns = [self._column(f, part, rows, field.name, field.dataType) for field in self.fields]
            table = pa.RecordBatch.from_arrays(columns, schema=pa.schema([(x.name, _arrow(x.dataType)) for x in self.fields]))
        finally:
            f.close()
        for i in range(0, n, BATCH):
            yield table.slice(i, min(BATCH, n - i))

    def _column(self, f, part: Range, rows: int, name: str, kind: T.DataType) -> pa.Array:
        n, to = part.stop - part.first, _arrow(kind)
        if name == "path":
            return pa.array([part.path] * n, to)
        if name == "row":
            return pa.array(np.arange(part.first, part.stop), to)
        if name not in f.arrays and isinstance(kind, T.StructType) and any(k.startswith(f"{name}/") for k in f.arrays):
            return pa.StructArray.from_arrays([self._column(f, part, rows, f"{name}/{x.name}", x.dataType) for x in kind], fields=list(to))
        a = f.arrays.get(name)
        width = a.width(rows) if a else None
        if a is None or width is None:
            return pa.nulls(n, to)
        if a.text:
            return pa.array([f.read(name, 0, 1)] * n, to)
        z = np.repeat(f.read(name, 0, 1), n, axis=0) if a.single else f.read(name, part.first, part.stop)
        flat = np.ascontiguousarray(z).reshape(-1)
        inner = to.value_type if width > 1 else to
        if a.complex:
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p)).cast(t.type) for p, t in zip((flat.real, flat.imag), inner)], fields=list(inner))
        else:
            values = pa.array(flat.astype(bool) if a.boolean else flat).cast(inner)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values) if width > 1 else values


def table(spark: SparkSession, source: type[ArraySource], path: str, columns: list[str] | None = None, **options: str | int) -> DataFrame:
    """The files of a path as a table; of the columns named here, or all.  Arrays that are not named are never unpacked."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    if columns is not None:
        schema = source({"path": path, **{k: str(v) for k, v in options.items()}}).schema()
        reader = reader.schema(T.StructType([schema[c] for c in columns]))
    return reader.load(path)
