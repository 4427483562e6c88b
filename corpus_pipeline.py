"""Corpus preparation in five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read again as the
next stage's input.  All but the last return the columns of ``documents``.  Filters decide by row, so neither null nor
repeated ids matter to them; null texts score like empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visloom.llm import decontaminate, exact_dedup, mixing, near_dup, quality
from visloom.storage import discard, noting, written


ROWS = 1_000  # of an Arrow batch of documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more."""
    held = quality.held_out()
    model = quality.fit(docs, quality.sample(quality.learning_labels(_table(spark, sf_dir, "labels"), held)))
    return quality.good(docs, model, threshold=0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the largest id."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at Jaccard 0.8 over five-word shingles: the one with the smallest id."""
    return near_dup.keep_first(docs, near_dup.Rule(k=5, num=4, den=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, domain posterior, rate and expected tokens of each document."""
    return mixing.mixed(docs, _table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the fitted rates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what earlier stages wrote is discarded."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noting() as made:
            found = stage(spark, docs, sf_dir)
        docs = written(found, f"pipeline-{name}", batch=ROWS)
        discard(*made, *before)
        before = [docs]
    return docs
