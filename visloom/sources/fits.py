"""FITS images: a folder of files to a long table, and a small image to a file.

Reading is a ``binaryFile`` scan, so Spark deals files to tasks; each task decodes its own.  The first header-and-data unit
with two non-trivial axes is expected; a file that holds none is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from visloom.sources.sink import write_files

UNIT = 2880
# FITS codes of pixel types, all big-endian.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _cards(content: bytes) -> tuple[dict[str, str], int]:
    found: dict[str, str] = {}
    for at in range(0, len(content), 80):
        card = content[at : at + 80].decode("ascii", "replace")
        if card.startswith("END") and not card[3:].strip():
            return found, -(-(at + 80) // UNIT) * UNIT
        if card[8:10] == "= ":
            found[card[:8].strip()] = card[10:].split("/")[0].strip()
    raise ValueError("no end of the FITS header")


def decode(content: bytes) -> np.ndarray:
    """The image of a FITS file, scaled as its header says; leading axes of length one are dropped."""
    head, start = _cards(content)
    shape = [int(head[f"NAXIS{i}"]) for i in range(int(head.get("NAXIS", 0)), 0, -1)]
    while len(shape) > 2 and shape[0] == 1:
        shape = shape[1:]
    if len(shape) != 2:
        raise ValueError("not a two-dimensional FITS image")
    raw = np.frombuffer(content, TYPES[int(head["BITPIX"])], shape[0] * shape[1], start)
    return raw.reshape(shape) * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))


def encode(image: np.ndarray) -> bytes:
    cards = [("SIMPLE", "T"), ("BITPIX", "-64"), ("NAXIS", "2"), ("NAXIS1", str(image.shape[1])), ("NAXIS2", str(image.shape[0]))]
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    body = np.ascontiguousarray(image, ">f8").tobytes()
    return head.encode().ljust(-(-len(head) // UNIT) * UNIT) + body.ljust(-(-len(body) // UNIT) * UNIT, b"\0")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, v) of every pixel of the FITS files that the path or pattern names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                image = decode(content)
                y, x = np.indices(image.shape, np.int32)
                yield pd.DataFrame({"path": name, "y": y.ravel(), "x": x.ravel(), "v": image.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, y int, x int, v double")


def files_of(images: DataFrame) -> DataFrame:
    """(path, y, x, v) -> path and the content of its FITS file, one image a group; missing pixels are zero."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(), frame["x"].to_numpy()
        image = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1))
        image[y - y.min(), x - x.min()] = frame["v"].to_numpy()
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [encode(image)]})

    return images.select("path", "y", "x", "v").groupBy("path").applyInPandas(one, "path string, content binary")


def write_images(images: DataFrame, path: str, overwrite: bool = True, prefix: str = "") -> None:
    """One FITS file in the folder ``path`` for each image of (path, y, x, v), named by the last part of its path; all or none."""
    files = files_of(images).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    write_files(files, path, overwrite, prefix)
