"""Benchmark decontamination: BM25 retrieval of test items by every training passage, then verification.

The test items, cut into parts of at most PART words, form an inverted index: for each term its parts
in order, with BM25 impacts, cut into blocks of BLOCK postings with the largest impact of each.  Every
document is cut into passages of 2 * PART words that begin every PART words, so a whole copy of any part
lies inside one passage.  A passage's score for a part is divided by the part's own score, so a full
copy scores 1.  Retrieval is block-max WAND at a fixed threshold: a passage whose terms' largest impacts
do not add up to the threshold has no pivot and is skipped, and so is one whose terms' maxima add up to
the threshold in no range of RANGE parts (both for many passages at once); for the others cursors move
from pivot to pivot, past blocks whose maxima stay below the threshold.  Nothing above the threshold is
lost.  Each item of a retrieved part is verified: the share of the item's shingles (five words), of its question's
and of its answer's that the document holds.

Document frequencies, the number of parts and their mean length are those of the whole benchmark.  The
index in the tasks holds up to SHARD_BYTES of benchmark text; a larger benchmark takes one more scan for
each further SHARD_BYTES, with the same rows as result.

Defined results: null and empty texts match nothing; items without words are not searched for; an item
of fewer than five words is one shingle, its whole word sequence, and is held by every text in which these
words stand one after another; of very long texts every passage is a query, and long items are found by their
parts; items of equal scores are all returned; repeated items and rows each give their rows; other columns are
ignored, whatever their names; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.llm.rows import filtered
from visloom.llm.textbytes import shingle_hashes, slices, utf8, word_hashes

K1, B, BLOCK, RANGE, PART, SHARD_BYTES = 1.2, 0.75, 8, 2, 40, 64_000_000
ENTRIES = 1_000_000  # in one step of a task
SLACK = 1e-9  # of sums of impacts in another order
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass(frozen=True)
class Statistics:
    """Sorted term hashes of the whole benchmark with the number of parts that hold each, parts, and their mean words."""

    terms: np.ndarray
    df: np.ndarray
    parts: int
    mean: float


@dataclass(frozen=True)
class Index:
    """Postings of one shard by term, with impacts relative to each part's own score, and its items' shingles."""

    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # first posting of each term
    part: np.ndarray  # by posting, ascending within a term
    impact: np.ndarray
    block: np.ndarray  # first block of each term
    block_most: np.ndarray  # largest impact and last part by block
    block_last: np.ndarray
    most: np.ndarray  # largest impact by term
    range_first: np.ndarray  # first entry of each term among its ranges of RANGE parts
    range_of: np.ndarray  # by entry: the range, and the term's largest impact in it
    range_most: np.ndarray
    item: np.ndarray  # by part
    ids: list
    question: list[tuple[int, np.ndarray]]  # words of a shingle, and the shingles
    answer: list[tuple[int, np.ndarray]]
    whole: list[tuple[int, np.ndarray]]


def _hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.string()))
    return word_hashes(data, offsets)


def split_item(text: str, least: int = 9) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, with as many before it as give ``least`` words.

    Where either side would have fewer words, both are the whole item.
    """
    parts = [p for p in SENTENCE.split(text.strip()) if p]
    for tail in range(len(parts) - 1, 0, -1):
        question, answer = " ".join(parts[:tail]), " ".join(parts[tail:])
        if len(answer.split()) >= least and len(question.split()) >= least:
            return question, answer
    return text, text


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return shingle_hashes(words, np.zeros(len(words), np.int64), 1, k)[0]


def _parts(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each word, item of each part): every item is cut into equal parts of at most PART words."""
    size = np.bincount(owner, minlength=n)
    many = -(-size // PART)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return (np.cumsum(many) - many)[owner] + at * many[owner] // size[owner], np.repeat(np.arange(n), many)


def statistics(items: DataFrame, text_col: str) -> Statistics:
    """Counts over the whole benchmark; the driver gets one number for each distinct word of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner = _hash(batch.column(0).to_pylist())
            part, item = _parts(owner, batch.num_rows)
            size = np.bincount(part, minlength=len(item))
            for i in range(0, len(item), 1000):
                here = (part >= i) & (part < i + 1000)
                pairs = np.unique(np.stack([part[here].astype(np.uint64), words[here]], 1), axis=0)
                term, df = np.unique(pairs[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], ["term", "df"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int(size.sum()) << 32 | len(item)])], ["term", "df"])

    counts = items.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = counts.column("term").combine_chunks(), counts.column("df").to_numpy()
    none = term.is_null().to_numpy(zero_copy_only=False)
    sums = int(df[none].sum()) if none.any() else 0
    term, df = term.filter(pa.array(~none)).to_numpy().view(np.uint64), df[~none]
    order = np.argsort(term)
    return Statistics(term[order], df[order], sums & 0xFFFFFFFF, (sums >> 32) / max(sums & 0xFFFFFFFF, 1))


def build_index(items: list[tuple[object, str]], k: int, seen: Statistics) -> Index:
    """Index of one shard; items are (id, text) with at least one word each."""
    words, owner = _hash([t for _, t in items])
    part, item = _parts(owner, len(items))
    terms, at = np.unique(words, return_inverse=True)
    n, size = len(item), np.bincount(part, minlength=len(item))
    pair, tf = np.unique(at.astype(np.int64) * n + part, return_counts=True)
    term, part = pair // n, pair % n
    df = seen.df[np.searchsorted(seen.terms, terms)][term]
    idf = np.log1p((seen.parts - df + 0.5) / (df + 0.5))
    impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[part] / max(seen.mean, 1)))
    impact = impact / np.bincount(part, impact, n)[part]
    many = np.bincount(term, minlength=len(terms))
    first = np.concatenate([[0], np.cumsum(many)])
    blocks = -(-many // BLOCK)
    block = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(first[:-1] - block[:-1] * BLOCK, blocks) + np.arange(block[-1]) * BLOCK
    last = np.minimum(begin + BLOCK, np.repeat(first[1:], blocks)) - 1
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] // RANGE != part[:-1] // RANGE)]))
    ranges = np.concatenate([np.searchsorted(term[new], np.arange(len(terms))), [len(new)]])
    pieces = [split_item(t) for _, t in items]

    def shingles(texts: list[str]) -> list[tuple[int, np.ndarray]]:
        h, d = _hash(texts)
        at = np.searchsorted(d, np.arange(len(texts) + 1))
        return [(n := min(k, max(int(b - a), 1)), _shingles(h[a:b], n)) for a, b in zip(at, at[1:])]

    return Index(
        terms, first, part, impact, block, np.maximum.reduceat(impact, begin), part[last], np.maximum.reduceat(impact, first[:-1]), ranges, part[new] // RANGE, np.maximum.reduceat(impact, new), item,
        [i for i, _ in items], shingles([q for q, _ in pieces]), shingles([a for _, a in pieces]), shingles([t for _, t in items]),
    )


def block_max_wand(terms: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, float]]:
    """(part, score) of every part that these distinct terms score ``threshold`` or more, in order."""
    part, impact, most, last = (memoryview(x) for x in (index.part, index.impact, index.block_most, index.block_last))
    # a cursor: its part, posting, end of postings, largest impact, and what turns a posting into its block
    cursors = [[part[a], a, b, m, a, k] for a, b, m, k in zip(*(x.tolist() for x in (index.first[terms], index.first[terms + 1], index.most[terms], index.block[terms])))]
    while True:
        cursors.sort()
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[3]
            if total >= threshold - SLACK:
                pivot = i
                break
        if pivot < 0:
            return
        at = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
            pivot += 1
        bound, past = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
        for c in cursors[: pivot + 1]:
            if c[0] < at:
                c[1] = bisect_left(part, at, c[1], c[2])
                c[0] = part[c[1]] if c[1] < c[2] else -1
            if c[1] < c[2]:
                k = c[5] + (c[1] - c[4]) // BLOCK
                bound += most[k]
                past = min(past, last[k] + 1)
        if bound < threshold - SLACK:  # no part before the end of these blocks, or before the next cursor, can do
            for c in cursors[: pivot + 1]:
                if c[1] < c[2]:
                    c[1] = bisect_left(part, past, c[1], c[2])
        else:
            held = [c for c in cursors[: pivot + 1] if c[0] == at]
            score = sum(impact[c[1]] for c in held)
            if score >= threshold:
                yield at, score
            for c in held:
                c[1] += 1
        cursors = [c for c in cursors if c[1] < c[2]]
        for c in cursors:
            c[0] = part[c[1]]


def _open_passages(start: np.ndarray, stop: np.ndarray, term: np.ndarray, index: Index, threshold: float) -> Iterator[int]:
    """The passages (terms start to stop) for which some range of parts has maxima that reach the threshold."""
    ranges, lo = int(index.range_of.max()) + 1, 0
    begin, many = index.range_first[term], index.range_first[term + 1] - index.range_first[term]
    before = np.concatenate([[0], np.cumsum(many)])
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(before[stop], before[start[lo]] + ENTRIES, "right")))
        t = slice(start[lo], stop[hi - 1])
        entry = np.repeat(begin[t] - before[t] + before[t.start], many[t]) + np.arange(before[t.stop] - before[t.start])
        own = np.repeat(np.arange(hi - lo), before[stop[lo:hi]] - before[start[lo:hi]])
        # only ranges that a term of the passage is in are summed, however many the benchmark has
        key = own * ranges + index.range_of[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(index.range_most[entry[order]], new)
        yield from lo + np.unique(key[new[sums >= threshold - SLACK]] // ranges)
        lo = hi


def candidates(words: np.ndarray, doc: np.ndarray, index: Index, threshold: float) -> np.ndarray:
    """Distinct (document, item, largest score) rows of the parts that a passage scores ``threshold`` or more."""
    none = np.zeros((0, 3))
    at = np.searchsorted(index.terms, words)
    at[at == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[at] == words)
    if not len(known):
        return none
    first = np.searchsorted(doc, np.arange(doc[-1] + 2))  # word position at which each document begins
    local = known - first[doc[known]]
    grid = np.concatenate([[0], np.cumsum(np.diff(first) // PART + 1)])  # passages are numbered through all documents
    here = grid[doc[known]] + local // PART
    # a word is in the passage that begins at its step and in the one that began a step before
    pairs = np.concatenate([here, (here - 1)[local >= PART]])
    term = np.concatenate([at[known], at[known][local >= PART]]).astype(np.int64)
    key = np.unique(pairs.astype(np.int64) * len(index.terms) + term)
    passage, term = key // len(index.terms), key % len(index.terms)
    bound = np.bincount(passage, index.most[term])
    keep = bound[passage] >= threshold - SLACK
    passage, term = passage[keep], term[keep]
    if not len(passage):
        return none
    start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    stop = np.concatenate([start[1:], [len(passage)]])
    hits = [
        (passage[start[w]], index.item[x], score)
        for w in _open_passages(start, stop, term, index, threshold)
        for x, score in block_max_wand(term[start[w] : stop[w]], index, threshold)
    ]
    if not hits:
        return none
    found = np.array(hits)
    found[:, 0] = np.searchsorted(grid, found[:, 0], "right") - 1
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
    return found[new]


def indexes(items: DataFrame, id_col: str, text_col: str, k: int) -> Iterator[Index]:
    """Indexes of the items, each of bounded bytes."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).head()["b"]
    seen, shards = statistics(rows, "t"), max(1, -(-size // SHARD_BYTES))
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).orderBy("i", "t")
        found = [(r["i"], r["t"]) for r in part.toLocalIterator() if len(_hash([r["t"]])[0])]
        if found:
            yield build_index(found, k, seen)


def verified(column: pa.Array, index: Index, threshold: float, overlap: float, part: float, k: int) -> Iterator[tuple]:
    """(row, item id, score, item, question and answer overlap, contaminated) of each retrieved pair of a text column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        words, doc = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(words):
            continue
        found = candidates(words, doc, index, threshold)
        for d in np.unique(found[:, 0]).astype(int):
            own = words[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            held: dict[int, np.ndarray] = {}
            for _, x, score in found[found[:, 0] == d]:
                shares = []
                for n, pieces in (s[int(x)] for s in (index.whole, index.question, index.answer)):
                    if n not in held:
                        held[n] = _shingles(own, n) if len(own) >= n else np.zeros(0, np.uint64)
                    shares.append(float(np.isin(pieces, held[n]).mean()))
                w, q, a = shares
                yield i + d, index.ids[int(x)], float(score), w, q, a, w >= overlap and q >= part and a >= part


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, k: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; a filter inside the scan, without a shuffle."""
    place = docs.columns.index(text_col)

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                ok[[r[0] for r in verified(batch.column(place), index, threshold, overlap, part, k) if r[-1]]] = False
                yield batch.filter(pa.array(ok))

        return run

    for index in indexes(items, item_id, item_text, k):
        docs = filtered(docs, keep(index))
    return docs


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified (doc_id, item_id, score, item_overlap, question_overlap, answer_overlap, contaminated) rows of retrieved pairs.

    ``contaminated`` is true where the item's overlap reaches ``overlap`` and its question's and its answer's
    each reach ``part``; retrieved pairs below that are returned too.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("item_overlap"), F.lit(0.0).alias("question_overlap"), F.lit(0.0).alias("answer_overlap"), F.lit(True).alias("contaminated")).schema
    kind = {"int": pa.int32(), "string": pa.string()}.get(schema["item_id"].dataType.simpleString(), pa.int64())

    def search(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(verified(batch.column(1), index, threshold, overlap, part, k))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0])), pa.array(c[1], kind), *(pa.array(x) for x in c[2:])], ["doc_id", "item_id", "score", "item_overlap", "question_overlap", "answer_overlap", "contaminated"])

        return run

    found = None
    for index in indexes(items, item_id, item_text, k):
        hits = rows.mapInArrow(search(index), schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)
