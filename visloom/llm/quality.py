"""Quality classifier by supervised subword embeddings.

Hashed words and character n-grams, and the distances at which words recur, each have a learned vector; a
document is the average of its vectors; a softmax layer gives the two labels.  Training is numpy stochastic gradient
descent in one task over a bounded sample of labelled rows (``max_rows`` rows per label, those whose
ids have the smallest hashes, so it is the same at any partitioning).  A fitted model is two arrays of fixed size, so it
travels with the tasks that score; scoring folds the output layer into the table, which is the same sum.

Defined results: a null or empty text has no features and gets the score of the bias alone; labels
that are null or outside 0/1 are not learned from; without labelled rows of both kinds every score is
the share of label 1 (1.0 without any label); very long texts are scored whole; a score equal to the threshold
is good; rows that repeat are scored alike; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.llm.hashed_ngrams import features, means, sparse
from visloom.llm.rows import filtered, maybe_smallest, smallest
from visloom.llm.textbytes import slices, utf8

BITS, DIM, GRAMS = 16, 12, (3, 4)


@dataclass(frozen=True)
class Model:
    """Embedding rows, output layer and bias."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Per bucket and constant contribution to the log odds of label 1."""
        w = self.layer[:, 1] - self.layer[:, 0]
        return (self.table @ w)[:, None].astype(np.float32), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Plain SGD, one document a step, with a linearly falling rate; classes are weighed evenly."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    count = np.bincount(labels, minlength=2)
    if not len(labels) or not count.all():
        share = 1.0 if not len(labels) else count[1] / count.sum()
        return Model(table, layer, np.array([0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))], np.float32))
    weight = np.minimum(1.0, count[::-1] / count)  # the rarer label in full, the other scaled down to it
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            at, w = rows[i]
            e = table[at]
            h = w @ e
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = layer @ p
            layer -= lr * np.outer(h, p)
            bias -= lr * p
            table[at] = e - np.float32(lr * 16) * np.outer(w, back)
    return Model(table, layer, bias)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return features(data, offsets, BITS, GRAMS, words=True, lower=False)


def sample(labels: DataFrame, id_col: str = "doc_id", max_rows: int = 3000) -> DataFrame:
    """The ``max_rows`` rows of each label of (id, label) whose ids have the smallest hashes."""
    labels = labels.where("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    key = F.xxhash64(F.col(id_col), F.lit("sample"))
    few = labels.where(maybe_smallest(F.col("label"), sizes, key, max_rows)).withColumn("_key", key)
    return smallest(few, "label", ["_key", id_col], max_rows).drop("_key")


def fit(docs: DataFrame, sampled: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 20_000) -> Model:
    """Model from the documents of a bounded sample (id, label), which is broadcast: documents never move.

    Where ids repeat, ``max_rows`` is a hard bound on the documents learned from.
    """
    chosen = F.broadcast(sampled.withColumnRenamed(id_col, "_id"))
    rows = docs.select(id_col, text_col).join(chosen, F.col(id_col) == F.col("_id"))
    sample = rows.select(F.col("label").cast("int").alias("label"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                found = sparse(_features(data[part[0] : part[-1]], part - part[0]), j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())],
                    ["label", "k", "at", "w"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(k, lab, a, w) for b in batches for lab, k, a, w in zip(*(c.to_pylist() for c in b.columns))]
        seen.sort(key=lambda x: x[:2])
        feats = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(w, np.float32)) for _, _, a, w in seen]
        m = train(feats, np.array([x[1] for x in seen], np.int64))
        out = io.BytesIO()
        np.savez(out, table=m.table, layer=m.layer, bias=m.bias)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    feats = sample.mapInArrow(extract, "label int, k long, at binary, w binary").limit(max_rows)
    blob = feats.repartition(1).mapInArrow(learn, "model binary").head()
    if blob is None:  # no document to learn from
        return train([], np.zeros(0, np.int64))
    with np.load(io.BytesIO(bytes(blob["model"]))) as z:
        return Model(z["table"], z["layer"], z["bias"])


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (double) and quality_pred (int, 1 where the score reaches the threshold).

    Clashing columns of the input of these two names are replaced; ``good`` leaves them alone.
    """
    table, bias = model.folded()
    docs = docs.drop("quality_score", "quality_pred")
    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(0).alias("quality_pred")).schema
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column(place), table, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "quality_score", "quality_pred"])

    return docs.mapInArrow(run, schema)


def good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    table, bias = model.folded()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), table, bias) >= threshold))

    return filtered(docs, run)


def _scores(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = utf8(column)
    score = np.zeros(len(column))
    for i, j in slices(offsets, 500_000):
        part = offsets[i : j + 1]
        x = means(_features(data[part[0] : part[-1]], part - part[0]), table, j - i)[:, 0] + bias
        score[i:j] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return score


def learning_labels(labels: DataFrame, held: Column) -> DataFrame:
    """(doc_id, label) to learn from; one row per labelled id that is not held out."""
    ok = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    return ok.groupBy("doc_id").agg(F.max("quality").alias("label"))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold that is never learned from; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
