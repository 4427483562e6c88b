"""Files with given names and contents, all or none of a job.

Rows (name, content) are written to a temporary folder beside the files by the tasks and moved to their names when the job
commits; a job that fails, or a task that is run again, leaves nothing else behind.  Mode "append" does not touch a file that is
there already (the job fails before any is moved), "overwrite" replaces files of the same names and no others.  Two rows of one name
are an error.  The option ``prefix`` comes before every name.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from visloom.sources.arrays import located


@dataclass
class Moved(WriterCommitMessage):
    names: list[tuple[str, str]]  # temporary and final name


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if sorted(schema.names) != ["content", "name"]:
            raise ValueError("rows of the columns name and content are written")
        return NamedFilesWriter(self.options["path"], self.options.get("prefix", ""), overwrite)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, prefix: str, overwrite: bool):
        self.path, self.prefix, self.overwrite = path, prefix, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def _at(self, *parts: str) -> tuple[pafs.FileSystem, str]:
        fs, folder = located(self.path)
        return fs, posixpath.join(folder, *parts)

    def write(self, iterator: Iterator[Row]) -> Moved:
        done = []
        for row in iterator:
            name = self.prefix + row["name"]
            if not row["name"] or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no file name")
            fs, folder = self._at(self.temporary)
            fs.create_dir(folder, recursive=True)
            part = uuid.uuid4().hex
            with fs.open_output_stream(posixpath.join(folder, part)) as out:
                out.write(bytes(row["content"] or b""))
            done.append((part, name))
        return Moved(done)

    def commit(self, messages: list[Moved | None]) -> None:
        pairs = [p for m in messages if m for p in m.names]
        fs, folder = self._at()
        names = [n for _, n in pairs]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        there = [f.base_name for f in fs.get_file_info([posixpath.join(folder, n) for n in names]) if f.type != pafs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} and {len(there) - 1} more are there already")
        for part, name in pairs:
            if name in there:
                fs.delete_file(posixpath.join(folder, name))
            fs.move(posixpath.join(folder, self.temporary, part), posixpath.join(folder, name))
        self.abort(messages)

    def abort(self, messages: list[Moved | None]) -> None:
        fs, folder = self._at(self.temporary)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def write_files(files: DataFrame, path: str, overwrite: bool = False, prefix: str = "") -> None:
    """Write rows (name, content) as files of the folder ``path``."""
    files.sparkSession.dataSource.register(NamedFiles)
    writer = files.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append")
    writer.option("prefix", prefix).option("path", path).save()
