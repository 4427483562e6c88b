"""N-gram Jaccard join by parity sketches.

Each document's set of word shingles is hashed into blocks; a block's sketch is the XOR of the
64-bit hashes of its members, so a shingle that only one of two documents has changes exactly one
block, and the number of differing blocks bounds the symmetric difference from below.  A link needs
a symmetric difference of at most D = (1 - t) / (1 + t) * (size + size).  Inside a size band all
documents use the same number of blocks, k > D, so linked documents agree on at least k - D blocks
(the pigeonhole), and under one common order of blocks they agree on one of the first D + 1.  The
order puts blocks with many members first: empty blocks and blocks of one common shingle are not
emitted.  A document joins in its own band, and in the next one where a partner may lie there.

Documents with equal sets are one class from the start, so copies are never paired.  Candidates:

1. Blocks of up to SMALL classes: all their pairs.
2. Larger blocks: each class with the block's pivot, the class that shares most blocks with others; a
   pivot gives way to a weightier one with which it shares a block.
3. What these leave in different components is compared relative to its pivot p.  Symmetric
   differences do not change when both sets are XORed with a third, so x and y link only if the
   small sets x ^ p and y ^ p differ in at most D elements.  If these have no element in common, a
   link of x and y implies links of both with p, which step 2 has found.  Else their first common
   element, in an order that puts the rarest first, has at most D elements before it in both sets
   together.  So each set emits its first D + 1 elements with their places, and two sets meet where
   places add up to at most D: of two that meet, one has at most D / 2 before it, and those that
   have more never look at each other.  Texts of one template that differ in words of their own
   have these first, and meet nobody.

Pairs whose sizes or 512-bit parity sketches (one bit a shingle) rule a link out go no further; all
others are verified on whole texts with exact set sizes.  No candidate is dropped otherwise, so the
components are those of all links.

Defined results: a null, empty or white-space text has 0 shingles and is alone in its component; a
text with fewer words than a shingle is its whole sequence; repeated rows are one class; a null id
is ignored in a component's smallest id (null where all are null); an empty table gives an empty
result; other columns are ignored, whatever their names.  Shingles and set classes are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.llm.components import connected
from visloom.llm.rows import kept_rows, marked
from visloom.llm.textbytes import mix, shingle_hashes, slices, utf8, word_hashes
from visloom.storage import discard, written

SMALL, LEAST_BAND = 16, 8
ROWS = 1_000  # of an Arrow batch of texts
SKETCH = 512
FAR = 0x2545F4914F6CDD1D


@dataclass(frozen=True)
class Rule:
    """Shingle length and the Jaccard threshold num / den."""

    k: int = 5
    num: int = 4
    den: int = 5

    def most(self, sizes: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to this."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def largest(self, size: int) -> int:
        return size * self.den // self.num

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, blocks, blocks to emit) for a set of this size."""
        band = max(0, (max(size, 1) - 1).bit_length() - (LEAST_BAND - 1).bit_length())
        out, partner = [], self.largest(size)
        while True:
            top = LEAST_BAND << band
            d, worst = self.most(size + min(partner, top)), self.most(2 * top)
            if d:  # else only equal sets link, and those are one class
                out.append((band, worst + 1 + worst // 8 + 2, d + 1))
            if partner <= top:
                return out
            band += 1


def _blocks(h: np.ndarray, band: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and member counts of the blocks that a set fills, and keys of the empty ones."""
    at = (h % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=blocks)
    first = np.cumsum(count) - count
    full, empty = np.flatnonzero(count), np.flatnonzero(count == 0)
    x = np.bitwise_xor.reduceat(h[order], first[full])
    key = mix(mix(x) + full.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(band) * np.uint64(0x51ED27) + (count[full].astype(np.uint64) << np.uint64(40)))
    return key, count[full], mix(mix(empty.astype(np.uint64) + np.uint64(77)) + np.uint64(band))


def block_keys(h: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the blocks that a set emits; h holds its distinct shingle hashes."""
    out = []
    for band, blocks, emit in rule.bands(len(h)):
        key, count, empty = _blocks(h, band, blocks)
        if len(key) > emit:
            key = key[np.lexsort((key, -count))[:emit]]
        if len(key) < emit:  # so few members that empty blocks may be all that two sets share
            key = np.concatenate([key, empty[: emit - len(key)]])
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) of consecutive parts of a text column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        words, doc = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        flat, off = shingle_hashes(words, doc, j - i, k)
        yield i, flat, off


def features(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rk (row key), n, sid (class of equal sets), keys (null if this task has emitted the class already), sketch."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, n long, sid long, keys array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            n, sid, keys, sketch = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for i, flat, off in sets_of(b.column(2), rule.k):
                mixed = mix(flat + np.uint64(0x1234567))
                for d in range(len(off) - 1):
                    h = flat[off[d] : off[d + 1]]
                    if not len(h):
                        continue
                    n[i + d] = len(h)
                    s = int(mix(np.array([mixed[off[d] : off[d + 1]].sum() + np.uint64(len(h))]))[0].astype(np.int64))
                    sid[i + d] = s
                    if s not in seen:
                        seen.add(s)
                        keys[i + d] = block_keys(h, rule).view(np.int64)
                        odd = (np.bincount((h >> np.uint64(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)
                        sketch[i + d] = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), pa.array(sid, mask=n == 0), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "rk", "n", "sid", "keys", "sketch"],
            )

    return rows.mapInArrow(run, schema)


def linked(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, judged on their texts."""
    a, b = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    rows = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [c.to_numpy() for c in batch.columns[:2]]
            every, first, back = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
            column = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(first)).combine_chunks()
            sets: list[np.ndarray] = []
            for _, flat, off in sets_of(column, rule.k):
                sets += [flat[off[i] : off[i + 1]] for i in range(len(off) - 1)]
            ok = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = sets[back[r]], sets[back[r + batch.num_rows]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = rule.den * both >= rule.num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][ok]), pa.array(ids[1][ok])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _most(sizes: Column, rule: Rule) -> Column:
    return F.floor(sizes * (rule.den - rule.num) / (rule.den + rule.num))


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0))


def _possible(pairs: DataFrame, shapes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches do not rule out."""
    a, b = (shapes.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    apart, most = _apart(F.col("sa"), F.col("sb")), _most(F.col("na") + F.col("nb"), rule)
    return pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").where((F.abs(F.col("na") - F.col("nb")) <= most) & (apart <= most)).select("a", "b")


def shifted(groups: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Rows (p, sid, root) -> p, sid, root, n, s, elements: the set of sid XORed with that of p, and its size s.

    A set that is at least as far from p as the empty set is goes by its own elements, under the group FAR ^ p: else
    all of p would be in each such row.  Linked sets differ by D at most in their distance from p, so a set up to D
    beyond that edge goes both ways, and no link is lost.  An element is the shingle's hash mixed with the group.
    """
    own, base = texts.select("sid", F.col("text").alias("tx")), texts.select(F.col("sid").alias("p"), F.col("text").alias("tp"))
    rows = groups.hint("merge").join(own, "sid").hint("merge").join(base, "p").select("p", "sid", "root", "tx", "tp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, sid, root = (c.to_numpy() for c in batch.columns[:3])
            every, first, back = np.unique(p, return_index=True, return_inverse=True)
            pivots: list[np.ndarray] = []
            for _, flat, off in sets_of(batch.column(4).take(pa.array(first)), rule.k):
                pivots += [flat[off[i] : off[i + 1]] for i in range(len(off) - 1)]
            for i, flat, off in sets_of(batch.column(3), rule.k):
                out, parts = [], []
                for d in range(len(off) - 1):
                    own, base, r = flat[off[d] : off[d + 1]], pivots[back[i + d]], i + d
                    z = np.setxor1d(own, base, assume_unique=True)
                    both = [(p[r], z)] if len(z) <= len(base) + rule.most(len(own) + rule.largest(len(own))) else []
                    both += [(p[r] ^ FAR, own)] if len(z) >= len(base) else []
                    for group, x in both:
                        parts.append(mix(x ^ mix(np.array([group]).view(np.uint64))))
                        out.append((group, sid[r], root[r], len(own), len(x)))
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))
                elements = pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out)), elements], ["p", "sid", "root", "n", "s", "elements"])

    return rows.mapInArrow(run, "p long, sid long, root long, n long, s long, elements array<long>")


def first_elements(moved: DataFrame, shapes: DataFrame, rule: Rule) -> DataFrame:
    """Rows (h, place, sid, root, n, s, sketch): the elements that other components share among the first D + 1, rarest first.

    Sets of one component need not meet, so an element that one component alone holds counts like one that a set alone
    holds: no partner has it, and it comes before all others.
    """
    flat = moved.select("p", "sid", "root", F.explode("elements").alias("h"))
    held_by = flat.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = written(held_by.where("lo < hi").select("h", "c"), "near-shared")
    held = flat.drop("root").join(shared, "h").groupBy("p", "sid").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("g"))
    rows = moved.select("p", "sid", "root", "n", "s").join(held, ["p", "sid"])
    alone = F.col("s") - F.size("g")  # elements that no partner can have come before all others
    most = _most(F.col("n") + F.floor(F.col("n") * rule.den / rule.num), rule)
    rows = rows.withColumn("alone", alone).withColumn("first", F.slice("g", F.lit(1), F.greatest(most + 1 - alone, F.lit(0)).cast("int")))
    rows = rows.where("size(first) > 0").hint("merge").join(shapes.select("sid", "sketch"), "sid")
    out = rows.select("sid", "root", "n", "s", "sketch", "alone", F.posexplode("first").alias("i", "e"))
    return out.select(F.col("e.h").alias("h"), (F.col("alone") + F.col("i")).alias("place"), "sid", "root", "n", "s", "sketch")


def _meeting(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of different components that meet at an element early enough in both sets.

    Sizes and sketches are part of the join's condition, so that what they rule out is never a row.
    """
    most = _most(F.col("n") + F.floor(F.col("n") * rule.den / rule.num), rule)
    rows = rows.withColumn("early", 2 * F.col("place") <= most)
    x, y = rows.where("early").alias("x"), rows.alias("y")
    d = _most(F.col("x.n") + F.col("y.n"), rule)
    rest = F.least(F.col("x.s") - F.col("x.place"), F.col("y.s") - F.col("y.place"))  # this element and what may follow
    ok = (
        (F.col("x.h") == F.col("y.h"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.col("x.place") + F.col("y.place") <= d)
        & (F.abs(F.col("x.n") - F.col("y.n")) <= d)
        & (F.col("x.s") + F.col("y.s") - d <= 2 * rest)
        & (~F.col("y.early") | (F.col("x.sid") < F.col("y.sid")))
        & (_apart(F.col("x.sketch"), F.col("y.sketch")) <= d)
    )
    return x.join(y, ok).select(*_ordered(F.col("x.sid"), F.col("y.sid"))).distinct()


def classes(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, n, sid of each row; roots (v, root) of the classes that have links)."""
    feats = written(features(docs, rule, id_col, text_col), "near-features", batch=ROWS)
    # one row a class: any document with this set stands for it
    shapes = written(feats.where("sketch IS NOT NULL").select("sid", "n", "rk", "sketch").dropDuplicates(["sid"]), "near-shapes")
    emitted = feats.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "sid")
    multi = written(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-keys")
    # here and below: where both sides grow with the corpus, a join is never a broadcast
    members = written(emitted.hint("merge").join(multi, "key"), "near-members")

    small = members.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("sid")).alias("g")).where("size(g) > 1").select("g").distinct()
    first = small.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.slice("g", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    large = written(members.where(F.col("c") > SMALL).select("key", "sid").distinct(), "near-large")
    weight = large.groupBy("sid").agg(F.count(F.lit(1)).alias("w"))
    at = large.join(large.join(weight, "sid").groupBy("key").agg(F.max(F.struct("w", "sid")).alias("p")), "key")
    # a pivot that is a member of another key with a weightier one gives way to it, so a family of texts has few pivots
    over = at.groupBy("sid").agg(F.max("p").alias("top")).select(F.col("sid").alias("was"), F.col("top.sid").alias("p"))
    named = at.select("sid", F.col("p.sid").alias("was")).distinct()
    groups = written(named.join(over, "was").select("p", "sid").distinct(), "near-groups")
    star = groups.where("sid <> p").select(*_ordered(F.col("sid"), F.col("p")))
    pairs = written(_possible(first.unionByName(star).distinct(), shapes, rule), "near-pairs")

    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(groups.select("sid")).distinct()
    wanted = written(shapes.select("sid", "rk").join(ends, "sid"), "near-wanted")
    named = docs.select(F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    maybe = marked(named, F.col("rk"), wanted.select("rk"), "maybe").where("maybe")
    texts = written(maybe.hint("merge").join(wanted, "rk").select("sid", "text"), "near-texts")
    roots = connected(written(linked(pairs, texts, rule), "near-links", batch=ROWS))

    at = groups.join(roots, groups["sid"] == roots["v"], "left").select("p", "sid", F.coalesce("root", "sid").alias("root"))
    several = at.groupBy("p").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("p")
    moved = written(shifted(at.join(several, "p"), texts, rule), "near-shifted", batch=ROWS)
    early = written(first_elements(moved, shapes, rule), "near-first")
    more = written(linked(_meeting(early, rule), texts, rule), "near-links", batch=ROWS)
    discard(multi, members, large, groups, pairs, wanted, texts, moved, early, shapes)
    if not more.isEmpty():
        roots = _joined(roots, more)
    return feats.select("doc_id", "rk", "n", "sid"), roots


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the old ones are the vertices."""
    to = {k: roots.select(F.col("v").alias(k), F.col("root").alias(f"r{k}")) for k in "ab"}
    named = links.join(to["a"], "a", "left").join(to["b"], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = connected(named)
    new = over.select("v", F.col("root").alias("top"))
    ends = over.select("v", F.col("v").alias("root")).join(roots, "v", "left_anti")  # classes that had no link before
    return written(roots.unionByName(ends).join(new.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("top", "root").alias("root")), "roots")


def _components(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rk, n and root (null without shingles) of each row."""
    feats, roots = classes(docs, rule, id_col, text_col)
    return feats.join(roots, feats["sid"] == roots["v"], "left").select("doc_id", "rk", "n", F.coalesce("root", "sid").alias("root"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), one row per input row."""
    at = _components(docs, rule, id_col, text_col)
    alone = at.where("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    inside = at.where("root IS NOT NULL")
    least = inside.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return inside.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def keep_first(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id stays, a null id only where all are null.

    Rows are told apart by id and text, so an id that is also on another text decides nothing; of rows
    that repeat both, one stays.  Texts without words all stay.
    """
    inside = written(_components(docs, rule, id_col, text_col).where("root IS NOT NULL"), "near-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rk")
    best = inside.groupBy("root").agg(F.min_by("rk", order).alias("stays"))
    gone = written(inside.join(best, "root").where("rk <> stays").select(F.col("rk").alias("_row")).distinct(), "near-gone")
    return kept_rows(docs, F.xxhash64(id_col, text_col), gone, inside.groupBy(F.col("rk").alias("_row")).count().where("count > 1"))
