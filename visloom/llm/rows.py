"""Filters that decide by row and not by id, bitmaps that spare rows a shuffle, and samples by smallest hash."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


MOST_BITS, WORD = 27, 32768  # a bitmap has at most 2**MOST_BITS bits (16 MB), in rows of WORD bits


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the 64-bit ``key`` is not in ``keys`` (one column of these).

    The bitmap that is broadcast has about 16 bits a key and never more than 2**MOST_BITS; with many more keys than
    that it is true nearly everywhere, and the join that follows does all the work.
    """
    (column,) = keys.columns
    bits = min(max((16 * keys.count()).bit_length(), WORD.bit_length()), MOST_BITS)
    place = F.pmod(F.col(column), F.lit(1 << bits))
    maps = keys.select(F.floor(place / WORD).alias("_word"), (place % WORD).alias("_bit")).groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.pmod(key, F.lit(1 << bits))
    found = rows.withColumn("_at", at).join(F.broadcast(maps), F.floor(F.col("_at") / WORD) == F.col("_word"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") % WORD / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("1 << cast(_at % 8 as int)")
    return found.withColumn(name, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def maybe_smallest(label: Column, sizes: dict, key: Column, most: int) -> Column:
    """True for a little more than ``most`` rows of each label: all but surely it holds for the ``most`` smallest 64-bit ``key`` of each.

    ``sizes`` has the number of rows of each label; keys are hashes, so their values are spread evenly whatever that number is.
    """
    want = most + 6 * math.sqrt(most) + 50
    bounds = [F.lit(x) for k, n in sizes.items() if k is not None and n > want for x in (k, int(-(1 << 63) + want / n * (1 << 64)))]
    return F.coalesce(key < F.create_map(*bounds)[label], F.lit(True)) if bounds else F.lit(True)


def smallest(rows: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each label in this order; partitions send at most ``most`` rows a label to the task that decides."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def filtered(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through an Arrow function that lets rows go; columns are known to it by place, so any name will do."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def kept_rows(docs: DataFrame, row: Column, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key ``row`` is in ``gone`` (_row), and one row of each key in ``repeated`` (_row).

    Of rows that repeat a key the one with the smallest hash of all its columns stays.
    """
    # the whole row is one column, so that no name of its columns can clash with those made here
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    named = docs.select(F.struct(*own).alias("doc"), row.alias("_row"))
    # only rows that may be gone meet the list of those that are; the others stay where they are
    named = marked(named, F.xxhash64("_row"), gone.select(F.xxhash64("_row").alias("_row")), "_maybe")
    doubtful = named.where("_maybe").join(gone.hint("merge"), "_row", "left_anti")
    left = named.where("NOT _maybe").unionByName(doubtful).drop("_maybe")
    again = repeated.select("_row")
    if again.isEmpty():
        return left.select("doc.*")
    one = left.join(again, "_row", "left_semi").groupBy("_row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return left.join(again, "_row", "left_anti").select("doc.*").unionByName(one.select("doc.*"))
