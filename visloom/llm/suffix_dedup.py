"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A string of ``length`` bytes that starts at two places is a pair of equal prefixes of two suffixes.  Ranks of
all suffixes at every byte would be a row a byte; here only sampled positions get rows.  In each window of
``length`` bytes the leftmost least GRAM-byte hash is its anchor, so equal windows have equal anchors at equal offsets,
and windows with one anchor form a run of consecutive starts.  Ranks are fingerprints (64 bits, always compared together with
the rank before, so 128 bits in all), and each step doubles what a rank covers, ranks again and leaves out what is unique or decided:

1. rank = the GRAM bytes at the anchor.  A unique rank cannot be in a repeat.
2. rank = (first rank, all bytes of the run's windows).  Where it repeats, every window of the run does.
3. runs that share the first rank but not the second are cut into cells of CELL starts: rank = the bytes common to a cell's
   windows (unique: none repeats), then all the bytes of the cell (repeats: all do).
4. cells still open are ranked window by window.

Each step is one aggregation by rank and a join back, so a string with any number of copies is a counter and not
a group of rows.  What is judged is the input; overlapping repeats count, also inside one document.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; repeated rows are repeats of each
other; a null id is allowed; text length is unbounded (segments bound the work arrays, and equal runs that follow one
another, as in a text of one letter, are one row); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from visloom.llm.textbytes import Rolling, mix, slices, utf8
from visloom.storage import written

GRAM, CELL, SEGMENT = 32, 16, 256_000
BYTES, CELLS, ROWS = 1_000_000, 8_000, 1_000  # what one step of a task holds: bytes, cells, rows of a batch of texts
_POSITION = 22
_RUN = "rk long, p long, n int, x int, g long, e long, k int"


def least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, anchor's distance, gram rank, run rank, equal runs in a row) of each run of a batch.

    Runs of a periodic text that follow one another and are equal are one row.
    """
    roll = Rolling(data)
    g = roll.grams(GRAM)
    if len(g) < length - GRAM + 1:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    place = np.uint64((1 << _POSITION) - 1)
    low = least((g & ~place) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1)
    start = np.arange(len(low))
    doc = np.searchsorted(offsets, start, "right") - 1
    ok = start + length <= offsets[doc + 1]
    start, doc, anchor = start[ok], doc[ok], (low[ok] & place).astype(np.int64)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.concatenate([first, [len(start)]]))
    p, a, doc = start[first], anchor[first], doc[first]
    x, g, e = a - p, g[a].view(np.int64), roll.of(p, p + n - 1 + length).view(np.int64)
    same = np.zeros(len(p), bool)
    same[1:] = (p[1:] == (p + n)[:-1]) & np.logical_and.reduce([v[1:] == v[:-1] for v in (doc, n, x, g, e)])
    new = np.flatnonzero(~same)
    k = np.diff(np.concatenate([new, [len(p)]]))
    return doc[new], (p - offsets[doc])[new], n[new], x[new], g[new], e[new], k


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """Rows (rk, p, n, x, g, e, k): row key, first start, starts of a run, anchor offset, first and second rank, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            key = b.column(0).to_numpy()
            for i, j in slices(offsets, SEGMENT):
                base, size = offsets[i], int(offsets[j] - offsets[i])
                step = size if size < 2 * SEGMENT else SEGMENT  # only one document can be longer
                for s in range(0, max(size, 1), max(step, 1)):
                    part = data[base + s : base + min(size, s + step + (length - 1 if step < size else 0))]
                    own = offsets[i : j + 1] - base if step >= size else np.array([0, len(part)])
                    doc, p, n, x, g, e, k = runs(part, own, length)
                    if len(doc):
                        small = [pa.array(v.astype(np.int32)) for v in (n, x, k)]
                        yield pa.RecordBatch.from_arrays([pa.array(key[doc + i]), pa.array(p + s), *small[:2], pa.array(g), pa.array(e), small[2]], ["rk", "p", "n", "x", "g", "e", "k"])

    return docs.mapInArrow(run, _RUN)


def _cut(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell number) of every cell of runs that start x before their anchor.

    A start's distance from the anchor is x - (start - first start); cells are multiples of CELL in that distance.
    """
    hi, lo = x // CELL, (x - n + 1) // CELL
    many = (hi - lo + 1).astype(np.int64)
    row = np.repeat(np.arange(len(x)), many)
    return row, hi[row] - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))


def _salt(g: np.ndarray, q: np.ndarray) -> np.ndarray:
    return mix(g.view(np.uint64) + q.astype(np.int64).view(np.uint64) * np.uint64(0x9E37))


def _cells(texts: DataFrame, length: int) -> DataFrame:
    """Rows (rk, p, n, x, g, c, bytes) -> one row a cell: its run, number, core and whole rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data, offsets in _parts(batch, 6, BYTES):
                rk, p, n, x, g, c = (b.column(i).to_numpy() for i in range(6))
                row, q = _cut(x, n)
                top, bottom = np.minimum(x[row], q * CELL + CELL - 1), np.maximum(x[row] - n[row] + 1, q * CELL)
                o, roll, salt = offsets[row] + x[row], Rolling(data), _salt(g[row], q)
                core = mix(roll.of(o - q * CELL, o - (q * CELL + CELL - 1) + length) ^ salt)
                whole = mix(roll.of(o - top, o - bottom + length) ^ mix(salt + bottom.astype(np.int64).view(np.uint64)))
                small = [pa.array(v.astype(np.int32)) for v in (p[row], q, (p + x)[row] - top, top - bottom + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rk[row]), *small, pa.array(c[row] == 1), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["rk", "p", "q", "start", "n", "open", "core", "whole"],
                )

    return texts.mapInArrow(run, "rk long, p int, q int, start int, n int, open boolean, core long, whole long")


def _parts(batch: pa.RecordBatch, place: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes in its binary column, with these bytes and their offsets."""
    column = batch.column(place)
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    for i, j in slices(at, limit):
        part = column.buffers()[2]
        data = np.frombuffer(part, np.uint8)[at[i] : at[j]] if part is not None else np.zeros(0, np.uint8)
        yield batch.slice(i, j - i), data, at[i : j + 1] - at[i]


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Rows (rk, p, n, x, g, c, bytes, cells) -> one row a window of each of these cells: rk, p, open and its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, _, _ in _parts(batch, 6, BYTES):
                for i, j in slices(whole.column(7).offsets.to_numpy().astype(np.int64), CELLS):
                    b = whole.slice(i, j - i)
                    ((_, data, offsets),) = _parts(b, 6, 1 << 40)
                    rk, p, n, x, g, c = (b.column(k).to_numpy() for k in range(6))
                    lists = b.column(7)
                    flat, many = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
                    run_of = np.repeat(np.arange(b.num_rows), many)
                    away = (flat[:, None] * CELL + np.arange(CELL)[None, :]).ravel()
                    row = np.repeat(run_of, CELL)
                    inside = (away <= x[row]) & (away >= x[row] - n[row] + 1)
                    row, away = row[inside], away[inside]
                    begin = offsets[row] + x[row] - away
                    h = mix(Rolling(data).of(begin, begin + length) ^ mix(_salt(g[row], away) + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(rk[row]), pa.array((p + x)[row] - away), pa.array(c[row] == 1), pa.array(h.view(np.int64))], ["rk", "p", "open", "h"])

    return rows.select("rk", "p", "n", "x", "g", "c", "bytes", "cells").mapInArrow(run, "rk long, p long, open boolean, h long")


def _slices_of(rows: DataFrame, length: int) -> DataFrame:
    """(text, list of runs) -> the bytes that each run's windows cover."""
    names = ["rk", "p", "n", "x", "g", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            lists = b.column(1)
            text = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            every = lists.flatten()
            start = offsets[text] + every.field("p").to_numpy()
            size = every.field("n").to_numpy().astype(np.int64) - 1 + length
            ends = np.concatenate([[0], np.cumsum(size)])
            for i, j in slices(ends, BYTES):
                at = ends[i : j + 1] - ends[i]
                picked = data[np.repeat(start[i:j] - at[:-1], size[i:j]) + np.arange(at[-1])]
                part = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(picked)])
                yield pa.RecordBatch.from_arrays([*(every.field(k).slice(i, j - i) for k in names), part], [*names, "bytes"])

    return rows.mapInArrow(run, "rk long, p long, n int, x int, g long, c long, bytes binary")


def repeated_starts(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, p, n): the starts p..p+n-1 of the document with this row key begin a string that also starts elsewhere."""
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    every = written(_runs_of(keyed, length), "repeat-runs", batch=ROWS)
    shared = every.groupBy("g").agg(F.sum("k").alias("c"), F.min("e").alias("lo"), F.max("e").alias("hi")).where("c > 1").select("g", (F.col("lo") < F.col("hi")).alias("mixed"))
    # as a table of its own, so that both sides of the join are plain exchanges and a hot rank can be split
    some = written(every.join(written(shared, "repeat-ranks"), "g"), "repeat-shared")
    starts = F.col("n") * F.col("k")
    done = some.where("NOT mixed").select("rk", "p", starts.alias("n"))

    mixed = some.where("mixed")
    ranked = written(mixed.groupBy("g", "e").agg(F.sum("k").alias("c"), F.min(F.struct("rk", "p", "n", "x")).alias("r")), "repeat-ranked")
    again = mixed.join(ranked.where("c > 1").select("g", "e"), ["g", "e"]).select("rk", "p", starts.alias("n"))

    # one run stands for all of its second rank; only runs unique in it are still open
    open_runs = ranked.select("r.rk", F.struct("r.rk", "r.p", "r.n", "r.x", "g", "c").alias("run")).groupBy("rk").agg(F.collect_list("run").alias("runs"))
    cut = written(_slices_of(keyed.join(open_runs, "rk").select("text", "runs"), length), "repeat-slices", batch=ROWS)
    cells = written(_cells(cut, length), "repeat-cells")
    cores = cells.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("k > 1").select("core", (F.col("lo") < F.col("hi")).alias("mixed"))
    judged = written(cells.join(cores, "core").drop("core"), "repeat-judged")
    cell_hits = judged.where("NOT mixed AND open").select("rk", F.col("start").cast("long").alias("p"), "n")
    doubtful = judged.where("mixed")
    wholes = doubtful.groupBy("whole").agg(F.count(F.lit(1)).alias("k"), F.max("open").alias("some")).where("k > 1 AND some").select("whole")
    whole_hits = doubtful.where("open").join(wholes, "whole").select("rk", F.col("start").cast("long").alias("p"), "n")

    picked = doubtful.groupBy("rk", "p").agg(F.collect_list("q").alias("cells")).withColumn("p", F.col("p").cast("long"))
    one = written(_windows(cut.join(picked, ["rk", "p"]), length), "repeat-windows")
    twice = one.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("open").alias("some")).where("k > 1 AND some").select("h")
    window_hits = one.where("open").join(twice, "h").select("rk", "p", F.lit(1).alias("n"))
    return done.unionByName(again).unionByName(cell_hits).unionByName(whole_hits).unionByName(window_hits)


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, start, end): the maximal runs of bytes to remove from the document with this row key."""
    found = repeated_starts(docs, length, id_col, text_col).groupBy("rk", "p").agg(F.max("n").alias("n"))
    rows = written(found.select("rk", F.col("p").alias("start"), (F.col("p") + F.col("n") + (length - 1)).alias("end")), "repeat-starts")
    before = W.partitionBy("rk").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("rk").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    apart = rows.withColumn("far", F.max("end").over(before)).withColumn("new", (F.col("far").isNull() | (F.col("start") > F.col("far"))).cast("int"))
    return apart.withColumn("span", F.sum("new").over(so_far)).groupBy("rk", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, start and end), kept (binary: the bytes that stay, in order)."""
    spans = repeated_spans(docs, length, id_col, text_col)
    lists = spans.groupBy("rk").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    none = F.array().cast("array<struct<start: long, end: long>>")
    rows = keyed.join(lists, "rk", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = utf8(batch.column(1))
            for i, j in slices(ends, BYTES):
                b = batch.slice(i, j - i)
                data, offsets = utf8(b.column(1))
                many, flat = np.diff(b.column(2).offsets.to_numpy()), b.column(2).flatten()
                base = np.repeat(offsets[:-1], many)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, base + flat.field("start").to_numpy(), 1)
                np.add.at(edge, base + flat.field("end").to_numpy(), -1)
                stay = np.cumsum(edge[:-1]) == 0
                at = np.concatenate([[0], np.cumsum(stay)])[offsets]
                kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[stay])])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(at)), b.column(2), kept], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, schema)
