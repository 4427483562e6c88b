"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier over hashed character n-grams predicts each bit;
decoding picks the codeword with the smallest loss-weighted distance (logistic loss of the signed
margins) and flags a text as ambiguous where the runner-up is close.  Learning is numpy SGD in one
task over a bounded sample (``max_rows`` rows per language, those whose id and text have the smallest hashes).  Up to seven languages get the
exhaustive code (all distinct splits), more get seeded random codewords, of which the set with the
largest least distance among some draws is taken.

Defined results: a null text or one without a letter is "und" with score 1 and not ambiguous; with one learned
language every text with a letter gets it; with none, every text is "und"; rows with null lang are
scored but not learned from; very long texts are scored whole; of equally near codewords the first language by name
is taken and the text is ambiguous; rows that repeat are scored alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.llm.hashed_ngrams import features, means, sparse
from visloom.llm.rows import maybe_smallest, smallest
from visloom.llm.textbytes import slices, utf8

BITS, GRAMS = 15, (2, 3)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, math.ceil(10 * math.log2(n))))
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, least
    return best


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return features(data, offsets, BITS, GRAMS, words=False, lower=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 4, rate: float = 40.0, seed: int = 3) -> np.ndarray:
    """One column of weights per bit: logistic SGD, one document a step; the last row is the bias."""
    table = np.zeros(((1 << BITS) + 1, target.shape[1]), np.float32)
    rng, steps, done = np.random.default_rng(seed), epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            at, w = rows[i]
            z = w @ table[at] + table[-1]
            g = target[i] / (1 + np.exp(np.clip(target[i] * z, -30, 30)))
            table[at] += np.float32(lr) * np.outer(w, g).astype(np.float32)
            table[-1] += np.float32(lr * 0.001) * g.astype(np.float32)
    return table


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 800) -> tuple[list[str], np.ndarray]:
    """(languages in order, weights) from the ``max_rows`` rows of each language whose id and text have the smallest hashes."""
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 1), np.float32)
    key = F.xxhash64(id_col, text_col)
    sample = known.where(maybe_smallest(F.col(lang_col), sizes, key, max_rows)).select(F.col(lang_col).alias("lang"), key.alias("k"), F.col(text_col).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                found = sparse(_features(data[part[0] : part[-1]], part - part[0]), j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())],
                    ["lang", "k", "at", "w"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(k, lang, a, w) for b in batches for lang, k, a, w in zip(*(c.to_pylist() for c in b.columns))]
        seen.sort(key=lambda x: x[:2])
        feats = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(w, np.float32)) for _, _, a, w in seen]
        table = train(feats, code[[langs.index(x[1]) for x in seen]] if seen else np.zeros((0, code.shape[1]), np.float32))
        out = io.BytesIO()
        np.save(out, table)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    feats = smallest(sample.mapInArrow(extract, "lang string, k long, at binary, w binary"), "lang", ["k"], max_rows)
    blob = feats.repartition(1).mapInArrow(learn, "model binary").head()
    if blob is None:
        return langs, train([], np.zeros((0, code.shape[1]), np.float32))
    return langs, np.load(io.BytesIO(bytes(blob["model"])))


def identified(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", close: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous (the two best share of belief differ by less than ``close``)."""
    code, weights, bias = codewords(len(langs)), table[:-1], table[-1]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            best, score, unsure = np.full(n, -1), np.ones(n), np.zeros(n, bool)
            letters = np.array(batch.column(2).to_pylist(), bool)
            if len(langs) and n:
                margin = np.concatenate([means(_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), weights, j - i) for i, j in slices(offsets)]) + bias
                loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * code[None], -30, 30))).sum(2)
                belief = np.exp(loss.min(1, keepdims=True) - loss)
                belief /= belief.sum(1, keepdims=True)
                top = np.sort(belief, axis=1)
                best = np.where(letters, belief.argmax(1), -1)
                score = np.where(letters, top[:, -1], 1.0)
                unsure = letters & (top[:, -1] - (top[:, -2] if len(langs) > 1 else 0) < close)
            names = np.array([*langs, "und"], dtype=object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)
