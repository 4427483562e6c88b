"""Every file of a folder through one function, once: a stream of file names that ends when it has caught up.

Spark's file source keeps in the checkpoint which files were taken, so a second run takes the new ones only, and a run that was
killed goes on where it was.  A file's result is one folder under ``out``, overwritten if its batch is played again; a file whose
function fails becomes a row of the error table and does not stop the others.  Nothing but names passes through the driver, ``per_batch`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession


def folder_of(path: str) -> str:
    """A result's folder: the file's name and a hash of its whole path, as folders may hold files of one name."""
    return f"{path.rstrip('/').rsplit('/', 1)[-1]}-{blake2b(path.encode(), digest_size=6).hexdigest()}"


def process_files(spark: SparkSession, folder: str, make: Callable[[SparkSession, str], DataFrame], out: str, checkpoint: str, per_batch: int = 16, pattern: str = "*") -> None:
    """Write ``make(spark, path)`` under ``out``/results for every file of ``folder`` (and below it) that was not taken before.

    Errors are rows (path, error) under ``out``/errors.  Only what ``make`` and writing its result raise is caught.
    """

    def batch(files: DataFrame, number: int) -> None:
        session, failed = files.sparkSession, []
        for (path,) in files.collect():  # names, ``per_batch`` at the most
            at = f"{out}/results/{folder_of(path)}"
            try:
                make(session, path).write.mode("overwrite").parquet(at)
            except Exception as e:  # the file's own failure
                failed.append((path, f"{type(e).__name__}: {e}"[:2000]))
        if failed:
            session.createDataFrame(failed, "path string, error string").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = listed.option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
