"""Removal of word windows that an earlier document holds, by super-k-mer partitioning.

The minimiser of a window of ``length`` words is the least hash of its GRAM-word strings, so equal windows have equal minimisers.
Consecutive windows of one minimiser form a super-k-mer.

1. Each super-k-mer becomes a narrow row: document, first window, number of windows, minimiser and 128-bit hash of its words.
2. A minimiser that one document alone has cannot be in a repeat; the others are the buckets.
3. Equal super-k-mers are one row (aggregated before the shuffle) with their smallest and largest doc_id, and the words of one of them
   travel as one packed string to its bucket.
4. In a task, the windows of whole buckets are sorted by their words (word numbers from exact bytes, then ranks of 1, 2, 4, ... words), and equal
   ones get the smallest doc_id of all.  A bucket of more than BUCKET bytes of different strings (the edge of a passage that very
   many documents share) does not go to one task: its windows are aggregated one by one under 128-bit hashes instead.
5. Windows whose smallest doc_id is below that of an occurrence are joined back to it by the hash of its super-k-mer.

Nothing is capped; a key with any number of occurrences is a counter in steps 2 to 4, and the joins are plain ones whose hot keys adaptive
execution splits.

Defined results: doc_ids are integers; a null text has no words; documents under ``length`` words lose nothing; a repeat within one
document, or in a row of the same doc_id, is none; rows that repeat an id and text have equal results, and count once; a null id is
neither smaller nor larger than another, so such a row loses nothing and takes nothing from others; a text may be of any length (its super-k-mers are
cut after CUT windows, its words worked off in segments; about ten times its bytes are held in a task); other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.llm.suffix_dedup import least
from visloom.llm.textbytes import SPACE, Rolling, slices, spaced, utf8, word_bounds
from visloom.storage import discard, written

LENGTH, GRAM, CUT = 50, 16, 2048
SEGMENT, WORDS, ROWS = 1_000_000, 200_000, 1_000  # bytes of texts and words worked on at a time, rows of a batch of texts
BUCKET, CHUNK = 4_000_000, 2_000_000  # bytes of a bucket that one task sorts, and that it aims at sorting at once
_KEY = ["doc_id", "th"]


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, one space after each; start and end of each word; its text)."""
    flat, starts = spaced(data, offsets)
    solid = ~SPACE[flat]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first space after a word
    before = np.concatenate([[0], np.cumsum(keep)])[starts]
    flat = np.where(solid, flat, np.uint8(32))[keep]
    begin, end = word_bounds(flat) if len(flat) else (np.zeros(0, np.int64),) * 2
    return flat, begin, end, np.searchsorted(before, begin, "right") - 1


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, word starts, word ends, texts, places in the text) of up to WORDS windows of a text column at a time."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, SEGMENT):
        flat, begin, end, text = joined_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        place = np.arange(len(begin)) - np.searchsorted(text, text, "left")
        for s in range(0, len(begin), WORDS):
            e = min(len(begin), s + WORDS + length - 1)
            low, high = begin[s], end[e - 1] + 1
            yield flat[low:high], begin[s:e] - low, end[s:e] - low, text[s:e] + i, place[s:e]


def super_kmers(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimiser) of each run of windows with one minimiser, and the end of its words."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(begin) < length:
        return none
    words = Rolling(flat).of(begin, end)
    low = least(Rolling(words, words).grams(gram), length - gram + 1)
    ok = text[: len(low)] == text[length - 1 :]
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (text[at[1:]] != text[at[:-1]]) | (at[1:] != at[:-1] + 1)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - np.flatnonzero(new)[run]) % CUT == 0
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    p = at[first]
    return p, n, low[p].view(np.int64), end[p + n + length - 2]


def _digests(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(flat))
    return [blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist())]


def _supers(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (doc_id, th, p, n, size, g, sid): document, first window, windows, bytes, minimiser, hash of the words."""
    names = ["doc_id", "th", "p", "n", "size", "g", "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for flat, begin, end, text, place in _pieces(b.column(2), length):
                p, n, g, stop = super_kmers(flat, begin, end, text, length, gram)
                if not len(p):
                    continue
                sid = pa.array(_digests(flat, begin[p], stop), pa.binary())
                small = [pa.array(v.astype(np.int32)) for v in (place[p], n, stop - begin[p])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[p]]), pa.array(th[text[p]]), *small, pa.array(g), sid], names)

    return keyed.mapInArrow(run, "doc_id long, th long, p int, n int, size int, g long, sid binary")


def _one_text(keyed: DataFrame) -> DataFrame:
    """``keyed`` with rows that repeat an id and text once."""
    again = written(keyed.groupBy(*_KEY).count().where("count > 1").select(*_KEY), "windows-repeated")
    if again.isEmpty():
        return keyed
    return keyed.join(again, _KEY, "left_anti").unionByName(keyed.join(again, _KEY, "left_semi").groupBy(*_KEY).agg(F.min("text").alias("text")))


def _packed(rows: DataFrame, length: int) -> DataFrame:
    """(text, list of super-k-mers) -> one row each with its words, joined by one space."""
    names = ["g", "sid", "lo", "hi", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            lists = b.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            every = lists.flatten()
            place, n = every.field("p").to_numpy(), every.field("n").to_numpy()
            for i, j in slices(offsets, SEGMENT):
                flat, begin, end, text = joined_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s, e = int(ends[i]), int(ends[j])
                of = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                first = np.searchsorted(text, of, "left") + place[s:e]
                low, high = begin[first], end[first + n[s:e] + length - 2]
                total = np.concatenate([[0], np.cumsum(high - low)])
                for k, m in slices(total, SEGMENT):
                    at = total[k : m + 1] - total[k]
                    picked = flat[np.repeat(low[k:m] - at[:-1], np.diff(at)) + np.arange(at[-1])]
                    part = pa.Array.from_buffers(pa.binary(), m - k, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(picked)])
                    yield pa.RecordBatch.from_arrays([*(every.field(c).slice(s + k, m - k) for c in names), part], [*names, "words"])

    return rows.mapInArrow(run, "g long, sid binary, lo long, hi long, hot boolean, words binary")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    part = column.buffers()[2]
    data = np.frombuffer(part, np.uint8)[at[0] : at[-1]] if part is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def window_ranks(flat: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` words from each word on; equal words, equal number (those that end in another text mean nothing)."""
    edges = np.concatenate([begin, [len(flat)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))])
    rank, done = words.dictionary_encode().indices.to_numpy().astype(np.int64), 1
    while done < length:
        step = min(done, length - done)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + ahead, return_inverse=True)[1].reshape(-1)
        done += step
    return rank


def _windows_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bytes, word starts, word ends, first word of each window, its string, its place there) of packed strings."""
    flat, begin, end, text = joined_words(data, offsets)
    at = np.flatnonzero(text[: max(len(text) - length + 1, 0)] == text[length - 1 :]) if len(text) >= length else np.zeros(0, np.int64)
    return flat, begin, end, at, text[at], at - np.searchsorted(text, text[at], "left")


def _least_of_bucket(table: pa.Table, length: int) -> pa.RecordBatch | None:
    """(sid, at, n, lo): runs of windows of whole buckets with one smallest doc_id, where that is below the string's largest."""
    rows = table.combine_chunks().to_batches()
    if not rows:
        return None
    (b,) = rows
    flat, begin, _, at, string, place = _windows_of(*_binary(b.column("words")), length)
    if not len(at):
        return None
    rank = window_ranks(flat, begin, length)[at]
    lo, hi = b.column("lo").to_numpy()[string], b.column("hi").to_numpy()[string]
    order = np.argsort(rank, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0]))
    best = np.empty_like(lo)
    best[order] = np.repeat(np.minimum.reduceat(lo[order], edge), np.diff(np.concatenate([edge, [len(order)]])))
    hit = np.flatnonzero(best < hi)
    if not len(hit):
        return None
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(string[hit]) != 0) | (np.diff(best[hit]) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(hit)]]))
    k = hit[first]
    return pa.RecordBatch.from_arrays([b.column("sid").take(pa.array(string[k])), pa.array(place[k].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(best[k])], ["sid", "at", "n", "lo"])


def _sorted_buckets(packed: DataFrame, length: int) -> DataFrame:
    """(sid, at, n, lo) from the packed strings of buckets that fit one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for i, j in slices(np.concatenate([[0], np.cumsum(_binary_sizes(b.column(4)))]), CHUNK):
                part = b.slice(i, j - i)
                held.append(part)
                size += int(_binary_sizes(part.column(4)).sum())
                g = part.column(0).to_numpy()
                last = int(np.searchsorted(g, g[-1], "left"))  # the last bucket may go on
                if size >= CHUNK and (last or len(held) > 1 and held[0].column(0)[0].as_py() != g[-1]):
                    table = pa.Table.from_batches(held)
                    whole = int(np.searchsorted(table.column(0).to_numpy(), g[-1], "left"))
                    if whole and (found := _least_of_bucket(table.slice(0, whole), length)) is not None:
                        yield found
                    held = table.slice(whole).combine_chunks().to_batches()
                    size = sum(int(_binary_sizes(x.column(4)).sum()) for x in held)
        if held and (found := _least_of_bucket(pa.Table.from_batches(held), length)) is not None:
            yield found

    ordered = packed.select("g", "sid", "lo", "hi", "words").repartition("g").sortWithinPartitions("g")
    return ordered.mapInArrow(run, "sid binary, at int, n int, lo long")


def _binary_sizes(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + column.offset + 1)[column.offset :]).astype(np.int64)


def _single_windows(packed: DataFrame, length: int) -> DataFrame:
    """(h, sid, at, lo, hi): one row a window of these strings, with the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.concatenate([[0], np.cumsum(_binary_sizes(b.column(4)))])
            for i, j in slices(sizes, SEGMENT // 4):
                part = b.slice(i, j - i)
                flat, begin, end, at, string, place = _windows_of(*_binary(part.column(4)), length)
                h = pa.array(_digests(flat, begin[at], end[at + length - 1]), pa.binary())
                rows = pa.array(string)
                yield pa.RecordBatch.from_arrays([h, part.column(1).take(rows), pa.array(place.astype(np.int32)), part.column(2).take(rows), part.column(3).take(rows)], ["h", "sid", "at", "lo", "hi"])

    return packed.select("g", "sid", "lo", "hi", "words").mapInArrow(run, "h binary, sid binary, at int, lo long, hi long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def earlier_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, start, end): words start..end-1 of this document are covered by windows that a smaller doc_id holds."""
    gram = min(gram, length)
    keyed = _keyed(docs, id_col, text_col).where("doc_id IS NOT NULL")
    every = written(_supers(keyed, length, gram), "windows-supers", batch=ROWS)
    ends = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    buckets = written(every.groupBy("g").agg(*ends).where("lo < hi").select("g"), "windows-shared")
    some = written(every.join(buckets, "g"), "windows-occurrences")
    discard(every)

    rep = F.min(F.struct("doc_id", "th", "p", "n", "size")).alias("rep")
    strings = written(some.groupBy("g", "sid").agg(*ends, rep), "windows-strings")
    hot = written(strings.groupBy("g").agg(F.sum("rep.size").alias("size")).where(F.col("size") > BUCKET).select("g", F.lit(True).alias("hot")), "windows-hot")
    marked = strings.join(hot, "g", "left").select("rep.doc_id", "rep.th", F.struct("rep.p", "rep.n", "g", "sid", "lo", "hi", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    lists = marked.groupBy(*_KEY).agg(F.collect_list("s").alias("supers"))
    packed = written(_packed(_one_text(keyed).join(lists, _KEY).select("text", "supers"), length), "windows-packed", batch=ROWS)
    discard(strings, hot)

    found = _sorted_buckets(packed.where("NOT hot"), length)
    single = written(_single_windows(packed.where("hot"), length), "windows-single")
    best = written(single.groupBy("h").agg(F.min("lo").alias("best")), "windows-best")
    again = single.join(best, "h").where("best < hi").select("sid", "at", F.lit(1).alias("n"), F.col("best").alias("lo"))
    hits = written(found.unionByName(again), "windows-hits")
    discard(packed, single, best)

    held = some.select(*_KEY, "p", "sid").join(hits, "sid").where("lo < doc_id")
    start = F.col("p") + F.col("at")
    spans = written(held.select(*_KEY, start.alias("start"), (start + F.col("n") + (length - 1)).alias("end")), "windows-spans")
    discard(some, hits, buckets)
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): one row a row of ``docs``."""
    spans = earlier_windows(docs, length, gram, id_col, text_col)
    lists = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    rows = _keyed(docs, id_col, text_col).join(lists, _KEY, "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = utf8(batch.column(1))
            for i, j in slices(ends, SEGMENT):
                b = batch.slice(i, j - i)
                flat, begin, end, text = joined_words(*utf8(b.column(1)))
                first = np.searchsorted(text, np.arange(b.num_rows + 1), "left")
                lists = b.column(2)
                many, every = np.diff(lists.offsets.to_numpy()), lists.flatten()
                base = np.repeat(first[:-1], many)
                edge = np.zeros(len(begin) + 1, np.int64)
                np.add.at(edge, base + every.field("start").to_numpy(), 1)
                np.add.at(edge, base + every.field("end").to_numpy(), -1)
                stay = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stay)])[first]
                bytes_of = np.repeat(stay, np.diff(np.concatenate([begin, [len(flat)]])))
                last = np.flatnonzero(stay)[left[1:][np.diff(left) > 0] - 1]
                bytes_of[end[last]] = False  # no space after the last word of a text
                size = np.concatenate([[0], np.cumsum(bytes_of)])
                at = size[np.concatenate([begin, [len(flat)]])[first]]
                kept = pa.Array.from_buffers(pa.string(), b.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[bytes_of]))])
                n_words = np.diff(first)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_words - np.diff(left)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)),
m AS (SELECT s, min(doc_id) AS lo FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE doc_id > lo),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h),
l AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
k AS (SELECT doc_id, j, w[j] AS x FROM d JOIN l USING (doc_id), unnest(range(1, len(w) + 1)) AS t(j) WHERE NOT list_contains(gone, j)),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, CASE WHEN l.doc_id IS NULL THEN 0 ELSE len(w) - coalesce(t.n, 0) END::BIGINT AS n_removed,
  sha256(CASE WHEN l.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t.kept, '') END) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)
"""
