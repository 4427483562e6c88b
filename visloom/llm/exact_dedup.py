"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep one id.

DataFrame functions only.  Every text is hashed once into a narrow table of digests.  Grouping these by
(128-bit hash, SHA-256) combines before the shuffle, so a group of copies reaches it as one row per map
task however many rows it has.  Only the texts of groups above one row are then grouped by their bytes,
again combined before the shuffle; where the bytes of one group differ, its rows are told apart by the
bytes themselves.  What is joined back to the rows is small (digests, kept id, size); adaptive execution
splits a hot digest on the row side of that join.

Defined results: a null text counts as empty; a null id sorts below every other, so it is kept only
where its whole group has null ids; rows that repeat an id and text are one document to this operator
and share one verdict (``kept`` is true on each, ``group_size`` counts them all), while ``keep_one``
lets one of them stay; an id that is on several texts decides nothing about the others; an empty table
gives an empty result; columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visloom.llm.rows import kept_rows, marked
from visloom.storage import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _row(id_: Column, norm: Column) -> Column:
    """Key of a row, 128 bits of id and text."""
    return F.struct(F.xxhash64(id_, norm).alias("a"), F.xxhash64(F.lit(1), norm, id_).alias("b"))


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """doc_id, row (key), sha (binary), keep_id, group_size of each row."""
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h128", F.unhex(F.md5("norm")))
    named = rows.select("doc_id", _row(F.col("doc_id"), F.col("norm")).alias("row"), "h128", F.unhex(F.sha2("norm", 256)).alias("sha"))
    digests = written(named, "exact-digests")
    verdict = [best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    groups = written(digests.groupBy("h128", "sha").agg(*verdict), "exact-groups")
    out = digests.join(groups, ["h128", "sha"])

    several = groups.where("group_size > 1").select("h128").distinct()
    maybe = marked(rows, F.xxhash64("h128"), several.select(F.xxhash64("h128").alias("h")), "maybe").where("maybe")
    texts = maybe.join(several, "h128", "left_semi").groupBy("h128", "norm").agg(*verdict)
    differ = texts.select("h128", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("h128", "sha").count()
    apart = written(differ.where("count > 1").select("h128").distinct(), "exact-collisions")
    if not apart.isEmpty():  # texts of one digest that differ in bytes
        named = rows.join(apart, "h128", "left_semi").join(texts, ["h128", "norm"])
        again = named.select("h128", F.unhex(F.sha2("norm", 256)).alias("sha"), "doc_id", _row(F.col("doc_id"), F.col("norm")).alias("row"), "keep_id", "group_size")
        out = out.join(apart, "h128", "left_anti").unionByName(again)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays in each group: the "max" or the "min".
    """
    out = _judged(docs, id_col, text_col, keep)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of ``docs`` of each set of equal texts."""
    found = _judged(docs, id_col, text_col, keep).where("group_size > 1")
    found = written(found.select("row", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "exact-rows")
    gone = written(found.where("NOT kept").select(F.col("row").alias("_row")).distinct(), "exact-gone")
    again = found.where("kept").groupBy(F.col("row").alias("_row")).count().where("count > 1")
    return kept_rows(docs, _row(F.col(id_col), normalised(F.col(text_col))), gone, again)


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
