"""Where intermediate tables live.

Executors and driver share only the folder named by ``spark.checkpoint.dir``.  Long jobs cut their
lineage by writing a table there; a machine-local folder is used only in local mode (as in tests)
where the setting is absent.  On a cluster without the setting, writing is an error.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_noted = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster; sets one only in local mode where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="visloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage behind it, so a lost executor costs a re-read and not a re-run, and
    the shuffle files of the job that wrote it are dropped when that job ends.  ``batch`` bounds the
    rows of an Arrow batch in this job, for rows that carry long values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    during = {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    for tables in getattr(_noted, "lists", []):
        tables.append(table)
    return table


@contextmanager
def noting() -> Iterator[list[DataFrame]]:
    """A list of the tables that ``written`` makes in this thread meanwhile, so that they can be discarded when nothing reads them any more."""
    _noted.lists = getattr(_noted, "lists", [])
    tables: list[DataFrame] = []
    _noted.lists.append(tables)
    try:
        yield tables
    finally:
        _noted.lists = [x for x in _noted.lists if x is not tables]


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing will read again."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
