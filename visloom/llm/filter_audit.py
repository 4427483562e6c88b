"""Audit of how document filters interact: what each removes, loses and repeats in every order.

A table-driven transducer reads the UTF-8 bytes of a text once.  Its states are "between words" and "in a word"; NEXT gives the
state after a byte of each class and EMITS what a transition emits: word begins, word ends, capital, code point, symbol.  The next state
depends on the byte's class alone, so the states of a batch are one table look-up and not a loop.  The word spans that it emits are
inserted in an open-addressing hash table, a whole batch in each probing round; a span is counted as seen only if the
text, the length and every byte of the slot's owner are the same, and goes to its next slot otherwise.

The counts make a bit mask of failed filters.  Texts are matched by length and SHA-256 of whole texts in a narrow table: grouping these
combines before the shuffle, and the join back to the rows is a plain one that adaptive execution splits where a text is hot.
Documents are then counted by part, mask and labels, at most 128 rows a part; all orders are worked out on these counts.

Defined results: a null text is empty; an empty text has no words, so it fails A only (and E where an earlier id has one too); texts may be of
any length (segments bound the arrays; one text is one segment at least); a null part is the empty string; a null id is neither smaller nor larger than
another and has no labels; rows that repeat an id and text do not fail E through each other; each row counts; of several label rows of an id one that
marks it is enough; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.llm.textbytes import mix, slices, spaced, utf8
from visloom.storage import written

FILTERS = "ABCDE"
SEGMENT, ROWS = 1_000_000, 1_000
SYMBOLS = b"#$%&*|"

# classes of bytes
SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, CONTINUATION = range(6)
CLASSES = 6
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[[32, 9, 10, 11, 12, 13]] = SPACE
CLASS[65:91] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[128:192] = CONTINUATION
CLASS[192:] = LEAD
# states, and the one after a byte of each class
BETWEEN, INSIDE = range(2)
NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
# what transition (state, class) emits
BEGIN, END, A_CAPITAL, A_POINT, A_SYMBOL = range(5)
EMITS = np.zeros((5, 2 * CLASSES), np.uint8)
for _state in (BETWEEN, INSIDE):
    for _class in range(CLASSES):
        _at = _state * CLASSES + _class
        EMITS[BEGIN, _at] = _state == BETWEEN and _class != SPACE
        EMITS[END, _at] = _state == INSIDE and _class == SPACE
        EMITS[A_CAPITAL, _at] = _class == CAPITAL
        EMITS[A_POINT, _at] = _class != CONTINUATION
        EMITS[A_SYMBOL, _at] = _class == SYMBOL

_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # the first k bytes of eight


class Spans:
    """Words of a batch of texts, as spans of bytes."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray):
        padded = np.concatenate([flat, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(flat) + 1,), "<u8", padded.data, strides=(1,))  # eight bytes from every place
        self.begin, self.size, self.text = begin, end - begin, text

    def chunk(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k..8k+7 of these words, zeros after their end."""
        return self.eights[self.begin[rows] + 8 * k] & _LOW[np.minimum(self.size[rows] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        rows, k = np.arange(len(self.begin)), 0
        h = mix(self.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64))
        while len(rows):
            h[rows] = mix(h[rows] ^ self.chunk(rows, k))
            k += 1
            rows = rows[self.size[rows] > 8 * k]
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are of one text and have the same bytes."""
        out = (self.text[a] == self.text[b]) & (self.size[a] == self.size[b])
        rows, k = np.flatnonzero(out & (a != b)), 0
        while len(rows):
            equal = self.chunk(a[rows], k) == self.chunk(b[rows], k)
            out[rows[~equal]] = False
            k += 1
            rows = rows[equal & (self.size[a[rows]] > 8 * k)]
        return out

    def first_seen(self, h: np.ndarray | None = None) -> np.ndarray:
        """Whether each word owns a slot of the table: one word of every set of equal words of a text does."""
        n = len(self.begin)
        h = self.hashes() if h is None else h
        slots = 1 << max(2 * n, 2).bit_length()
        table = np.full(slots, -1, np.int64)
        slot, step = (h & np.uint64(slots - 1)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
        owns, rows = np.zeros(n, bool), np.arange(n)
        while len(rows):
            at = slot[rows]
            free = rows[table[at] < 0]
            table[slot[free]] = free
            owner = table[at]
            owns[owner[owner == rows]] = True
            rows = rows[~self.same(rows, owner)]
            slot[rows] = (slot[rows] + step[rows]) & (slots - 1)
        return owns


def transduced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text: words, distinct words, capitals, code points, symbols."""
    flat, starts = spaced(data, offsets)  # a space ends each text
    out = np.zeros((len(starts), 5), np.int64)
    if not len(flat):
        return out
    kind = CLASS[flat]
    state = NEXT[kind]
    code = kind.copy()
    code[1:] += CLASSES * state[:-1]

    def count(what: int) -> np.ndarray:
        return np.add.reduceat(EMITS[what][code], starts, dtype=np.int64)

    begin, end = np.flatnonzero(EMITS[BEGIN][code]), np.flatnonzero(EMITS[END][code])
    text = np.searchsorted(starts, begin, "right") - 1
    seen = Spans(flat, begin, end, text).first_seen()
    out[:, 0] = np.bincount(text, minlength=len(starts))
    out[:, 1] = np.bincount(text[seen], minlength=len(starts))
    out[:, 2], out[:, 3], out[:, 4] = count(A_CAPITAL), count(A_POINT) - 1, count(A_SYMBOL)  # but for the space
    return out


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and n_words, n_distinct, n_capitals, n_points, n_symbols."""
    names = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(len(others)))
            parts = [transduced(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SEGMENT)]
            found = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, k]) for k in range(5))], [*others, *names])

    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, ", ".join([kinds, *(f"{c} long" for c in names)]))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask): bit k of the mask is set where the document fails filter k of FILTERS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("size"), text.alias("text"))
    rows = written(measured(rows), "audit-rows", batch=ROWS)
    first = written(rows.groupBy("sha", "size").agg(F.min("doc_id").alias("first")), "audit-first")
    fails: list[Column] = [
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        100 * F.col("n_capitals") > 3 * F.col("n_points"),
        F.col("n_symbols") > 0,
        F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.join(first, ["sha", "size"]).select("doc_id", "part", mask.alias("mask"))


def audit(failed: DataFrame, labels: DataFrame, filters: str = FILTERS, id_col: str = "doc_id") -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``failed`` has doc_id, part and mask; ``labels`` has the id, quality and toxic.
    """
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull())
    rows = failed.join(marks, "doc_id", "left")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 2**5 at most
    parts = written(parts, "audit-parts")

    orders = ["".join(p) for p in permutations(filters)]
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [(o, k + 1, bit[f], sum(bit[g] for g in o[:k])) for o in orders for k, f in enumerate(o)]
    table = F.arrays_zip(*[F.lit([s[k] for s in steps]).alias(name) for k, name in enumerate(("filter_order", "step", "own", "before"))])
    each = parts.select("part", "counts", F.explode(table).alias("s")).select("part", "counts", "s.*")

    def total(where, what: str = "n") -> Column:
        hit = F.filter("counts", lambda c: where(c["mask"]))
        return F.aggregate(hit, F.lit(0).cast("long"), lambda a, c: a + c[what])

    own, before = F.col("own"), F.col("before")
    fails, earlier = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    found = each.select(
        "part", "filter_order", "step", "own",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    shapley = found.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return found.join(shapley, ["part", "own"]).drop("own")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(lo < doc_id, false) AS E FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n,
  count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER ((mask & (own | before)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
