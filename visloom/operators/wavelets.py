"""Periodised orthonormal wavelets of long images, for many images and several bases in one plan.

One shuffle sorts the rows by image.  Images of at most WHOLE pixels a side then pass through all bases and levels as blocks of an Arrow
batch, and a task holds the images of one batch; what is needed of the coefficients (their rows, sums of each band, or the image made of
them) leaves the task, so that coefficients are rows only where rows are asked for.  Larger images are filtered by joins with the
tap table, of a few dozen rows, and stay partitioned by image.

A coefficient sums the pixels that are there and not null: it is null where all of them are, and has no row where none is there.  Rows
of one place are added.  Places outside the image take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.functions import columns as C

DIRAC = 0
WHOLE = 256
BANDS = ("ll", "lh", "hl", "hh")


def daubechies(order: int) -> list[float]:
    """Low-pass taps of the extremal-phase wavelet with ``order`` vanishing moments, by spectral factorisation."""
    halves = [math.comb(order - 1 + k, k) for k in range(order)]
    # roots in y of the half-band remainder, each mapped to the root in z inside the unit circle
    inside = []
    for y in np.roots(halves[::-1]) if order > 1 else []:
        z = np.roots([1, 4 * y - 2, 1])
        inside.append(z[np.argmin(np.abs(z))])
    taps = np.real(np.poly([-1.0] * order + inside))
    return [float(t) for t in taps * math.sqrt(2) / taps.sum()]


def high_pass(low: list[float]) -> list[float]:
    return [(-1) ** j * t for j, t in enumerate(reversed(low))]


def _taps(images: DataFrame, orders: list[int], sides: dict[int, int]) -> DataFrame:
    """Taps of each basis with their number and the side of the images that they meet: a few dozen rows."""
    rows = [(o, j, lo, hi, 2 * o, sides[o]) for o in orders for low in [daubechies(o)] for j, (lo, hi) in enumerate(zip(low, high_pass(low)))]
    return F.broadcast(images.sparkSession.createDataFrame(rows, "basis int, j int, lo double, hi double, len int, n int"))


def sides(size: int, orders: list[int], levels: int, mode: str) -> list[dict[int, int]]:
    """The side of each basis's input at every level, and of its last output."""
    out = [dict.fromkeys(orders, size)]
    for _ in range(levels):
        out.append({o: (n + 2 * o - 1) // 2 if mode == "zero" else n // 2 for o, n in out[-1].items()})
    return out


def sides_fit(size: int, levels: int, mode: str) -> None:
    if mode == "periodic" and size % (1 << levels):
        raise ValueError("the side must be a multiple of two to the power of the levels")


def _split(rows: DataFrame, taps: DataFrame, along: str, mode: str, keys: list[str], values: list[str]) -> DataFrame:
    """Low- and high-pass sums of each value at stride 2 along one axis, as columns value_l and value_h."""
    back = F.col(along) - F.col("j")
    at = F.pmod(back, F.col("n")) if mode == "periodic" else back + F.col("len") - 2
    near = rows.join(taps, "basis").withColumn("at", at).where("at % 2 = 0").withColumn(along, (F.col("at") / 2).cast("int"))
    sums = [F.sum(F.col(v) * F.col(tap)).alias(f"{v}{mark}") for v in values for tap, mark in (("lo", "l"), ("hi", "h"))]
    return near.groupBy("vec_id", "basis", *keys, along).agg(*sums)


def analysis(images: DataFrame, orders: list[int], size: int, levels: int, mode: str = "periodic") -> DataFrame:
    """(vec_id, y, x, v) -> vec_id, basis, level, band, y, x, v; level 1 is the finest, the last level has band ll too.

    ``periodic`` keeps the number of coefficients and needs a side divisible by two to the power of the levels; ``zero`` takes
    pixels outside as zero and gives (n + taps - 1) // 2 coefficients a side, of any n.
    """
    sides_fit(size, levels, mode)
    if size <= WHOLE:
        return _coefficient_rows(images, orders, size, levels, mode)
    met = sides(size, orders, levels, mode)
    rows = images.repartition("vec_id").select("vec_id", "y", "x", F.col("v").alias("s"), F.explode(F.array(*[F.lit(o) for o in orders])).alias("basis"))
    out = None
    for level in range(1, levels + 1):
        taps = _taps(images, orders, met[level - 1])
        both = _split(_split(rows, taps, "x", mode, ["y"], ["s"]), taps, "y", mode, ["x"], ["sl", "sh"])
        kept = "4, 'll', sll, 'lh', shl, 'hl', slh, 'hh', shh" if level == levels else "3, 'lh', shl, 'hl', slh, 'hh', shh"
        part = both.selectExpr("vec_id", "basis", f"{level} as level", f"stack({kept}) as (band, v)", "y", "x")
        out = part if out is None else out.unionByName(part)
        rows = both.selectExpr("vec_id", "basis", "y", "x", "sll as s")
    return out


def _merged(rows: DataFrame, taps: DataFrame, along: str, mode: str, keys: list[str], high: str) -> DataFrame:
    """Adjoint of ``_split``: each coefficient adds its taps along one axis; ``high`` says by which filter it was made."""
    at = 2 * F.col(along) + F.col("j")
    joined = rows.join(taps, "basis").withColumn(along, (F.pmod(at, F.col("n")) if mode == "periodic" else at + 2 - F.col("len")).cast("int"))
    if mode != "periodic":
        joined = joined.where((F.col(along) >= 0) & (F.col(along) < F.col("n")))
    return joined.groupBy("vec_id", "basis", *keys, along).agg(F.sum(F.col("v") * F.when(F.col(high), F.col("hi")).otherwise(F.col("lo"))).alias("v"))


def synthesis(coefficients: DataFrame, orders: list[int], size: int, levels: int = 1, mode: str = "periodic") -> DataFrame:
    """Inverse (and adjoint) of ``analysis`` by basis: vec_id, basis, y, x, v."""
    if size <= WHOLE:
        return _images_of_rows(coefficients, orders, size, levels, mode)
    met = sides(size, orders, levels, mode)
    rows = coefficients.where(F.col("basis") != DIRAC).repartition("vec_id")
    low = rows.where(f"level = {levels} AND band = 'll'")
    for level in range(levels, 0, -1):
        taps = _taps(coefficients, orders, met[level - 1])
        here = rows.where(f"level = {level} AND band <> 'll'").select("vec_id", "basis", "band", "y", "x", "v")
        here = here.unionByName(low.select("vec_id", "basis", F.lit("ll").alias("band"), "y", "x", "v"))
        here = here.select("*", F.col("band").isin("lh", "hh").alias("high_x"), F.col("band").isin("hl", "hh").alias("high_y"))
        low = _merged(_merged(here, taps, "x", mode, ["high_y", "y"], "high_x"), taps, "y", mode, ["x"], "high_y")
    return low.select("vec_id", "basis", "y", "x", "v")


class _Planes(NamedTuple):
    """Images of one side, (images, y, x); masks of places that are there and that are not null, or None where all are and are finite."""

    z: np.ndarray
    there: np.ndarray | None = None
    known: np.ndarray | None = None

    def turned(self) -> _Planes:
        return _Planes(*(None if m is None else m.swapaxes(1, 2) for m in self))


class _Bank(NamedTuple):
    """Both filters from one side to the next: the pixel that each tap of each coefficient meets (the side: none), and the matrices."""

    at: np.ndarray
    taps: list[np.ndarray]
    matrices: list[np.ndarray]


@lru_cache(maxsize=256)
def _bank(order: int, n: int, mode: str) -> _Bank:
    low = daubechies(order)
    taps = [np.array(low), np.array(high_pass(low))]
    m = sides(n, [order], 1, mode)[1][order]
    at = 2 * np.arange(m)[:, None] + np.arange(len(low))
    if mode == "periodic":
        at = at % n
    else:
        at = at + 2 - len(low)
        at[(at < 0) | (at >= n)] = n
    matrices = []
    for t in taps:
        wide = np.zeros((m, n + 1))
        np.add.at(wide, (np.arange(m)[:, None], at), np.broadcast_to(t, at.shape))
        matrices.append(np.ascontiguousarray(wide[:, :n]))
    return _Bank(at, taps, matrices)


def _times(z: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (z.reshape(-1, z.shape[-1]) @ matrix).reshape(*z.shape[:-1], matrix.shape[1])


def _halves(p: _Planes, bank: _Bank) -> list[_Planes]:
    """Low- and high-pass sums along x.  With masks each sum has its own pixels only, so that none that is not finite spreads."""
    if p.there is None:
        return [_Planes(_times(p.z, m.T)) for m in bank.matrices]
    z, there, known = (np.concatenate([a, np.zeros((*a.shape[:-1], 1), a.dtype)], axis=-1) for a in p)
    masks = [a[..., bank.at].any(axis=-1) for a in (there, known)]
    return [_Planes(sum(c * z[..., bank.at[:, j]] for j, c in enumerate(t)), *masks) for t in bank.taps]


def _united(halves: list[_Planes], bank: _Bank, n: int) -> _Planes:
    """Adjoint of ``_halves``: images whose rows have n pixels."""
    if halves[0].there is None:
        return _Planes(sum(_times(p.z, m) for p, m in zip(halves, bank.matrices)))
    z, there, known = (np.zeros((*halves[0].z.shape[:-1], n + 1), t) for t in (float, bool, bool))
    for p, t in zip(halves, bank.taps):
        for j, c in enumerate(t):
            z[..., bank.at[:, j]] += np.where(p.known, c * p.z, 0.0)
            there[..., bank.at[:, j]] |= p.there
            known[..., bank.at[:, j]] |= p.known
    return _Planes(*(a[..., :n] for a in (z, there, known)))


def _words(p: _Planes, order: int, size: int, levels: int, mode: str) -> Iterator[tuple[int, str, _Planes]]:
    """(level, band, coefficients), finest first, the last level's ll at the end."""
    for level in range(1, levels + 1):
        bank = _bank(order, p.z.shape[-1], mode)
        across = [[q.turned() for q in _halves(h.turned(), bank)] for h in _halves(p, bank)]  # [high x][high y]
        p = across[0][0]
        yield from ((level, b, across[hx][hy]) for b, hx, hy in (("lh", 1, 0), ("hl", 0, 1), ("hh", 1, 1)))
    yield levels, "ll", p


def _image(words: dict[tuple[int, str], _Planes], order: int, size: int, levels: int, mode: str) -> _Planes:
    met = sides(size, [order], levels, mode)
    low = words[levels, "ll"]
    for level in range(levels, 0, -1):
        n = met[level - 1][order]
        bank = _bank(order, n, mode)
        flat = [_united(pair, bank, n) for pair in ([low, words[level, "lh"]], [words[level, "hl"], words[level, "hh"]])]
        low = _united([f.turned() for f in flat], bank, n).turned()
    return low


def _gathered(batches: Iterator[pa.RecordBatch], places: dict[int, int]) -> Iterator[tuple[int, pa.Array, list[np.ndarray]]]:
    """(basis, ids, [sums, there, known]) from rows (basis, vec_id, place, v) in the order of the first two; the bases have so many places.

    What a batch leaves open, one image, waits for the next batch as sums.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        basis, ids, place, values = (b.column(i) for i in range(4))
        basis, place = basis.to_numpy(), place.to_numpy()
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        known = values.is_valid().to_numpy(zero_copy_only=False)
        v = np.where(known, values.fill_null(0.0).to_numpy(), 0.0)
        for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(basis)) + 1):
            o, count = int(basis[part[0]]), places[int(basis[part[0]])]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(code[part])) + 1])
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(part))))
            names, many = ids.take(pa.array(part[starts])), len(starts) * count
            ok = place[part] >= 0
            to, sure = run[ok] * count + place[part][ok], known[part][ok]
            sums = [np.bincount(to, v[part][ok], many), np.bincount(to, minlength=many) > 0, np.bincount(to[sure], minlength=many) > 0]
            sums = [a.reshape(-1, count) for a in sums]
            if held is not None:
                if held[0] == o and held[1][0].as_py() == names[0].as_py():
                    sums[0][0] += held[2][0][0]
                    sums[1][0] |= held[2][1][0]
                    sums[2][0] |= held[2][2][0]
                else:
                    yield held
            if len(starts) > 1:
                yield o, names[:-1], [a[:-1] for a in sums]
            held = o, names[-1:], [a[-1:].copy() for a in sums]
    if held is not None:
        yield held


def _kinds(ids: pa.Array, sums: list[np.ndarray]) -> Iterator[tuple[pa.Array, list[np.ndarray] | np.ndarray]]:
    """Images that are whole and finite, without masks, and the others with them; images without a place are left out."""
    z, there, known = sums
    whole = known.all(axis=1) & np.isfinite(z).all(axis=1)
    if whole.any():
        yield ids.filter(pa.array(whole)), z[whole]
    rest = ~whole & there.any(axis=1)
    if rest.any():
        yield ids.filter(pa.array(rest)), [a[rest] for a in sums]


def _over_blocks(images: DataFrame, size: int, schema: str, f: Callable[[pa.Array, _Planes], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``f`` over blocks of whole images."""
    inside = F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)
    place = F.when(inside, F.col("y") * size + F.col("x")).otherwise(-1).cast("int")
    rows = images.select(F.lit(DIRAC).alias("basis"), "vec_id", place.alias("place"), F.col("v").cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sums in _gathered(batches, {DIRAC: size * size}):
            for names, found in _kinds(ids, sums):
                parts = [found] if isinstance(found, np.ndarray) else found
                with np.errstate(invalid="ignore", over="ignore"):
                    yield from f(names, _Planes(*(a.reshape(-1, size, size) for a in parts)))

    return rows.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, schema)


def _rows(ids: pa.Array, fixed: dict[str, tuple[Any, pa.DataType]], p: _Planes) -> pa.RecordBatch:
    """vec_id, the fixed columns, y, x and v of every place that is there."""
    count, h, w = p.z.shape
    at = np.arange(count * h * w) if p.there is None else np.flatnonzero(p.there)
    own, y, x = np.unravel_index(at, p.z.shape)
    v = pa.array(p.z.ravel()[at], mask=None if p.known is None else ~p.known.ravel()[at])
    same = [pa.repeat(pa.scalar(value, kind), len(at)) for value, kind in fixed.values()]
    columns = [ids.take(pa.array(own)), *same, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), v]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", *fixed, "y", "x", "v"])


def _band(order: int, level: int, band: str) -> dict[str, tuple[Any, pa.DataType]]:
    return {"basis": (order, pa.int32()), "level": (level, pa.int32()), "band": (band, pa.string())}


def _coefficient_rows(images: DataFrame, orders: list[int], size: int, levels: int, mode: str) -> DataFrame:
    def f(ids: pa.Array, p: _Planes) -> Iterator[pa.RecordBatch]:
        for o in orders:
            for level, band, q in _words(p, o, size, levels, mode):
                yield _rows(ids, _band(o, level, band), q)

    return _over_blocks(images, size, f"vec_id {dict(images.dtypes)['vec_id']}, basis int, level int, band string, y int, x int, v double", f)


def _images_of_rows(coefficients: DataFrame, orders: list[int], size: int, levels: int, mode: str) -> DataFrame:
    met = sides(size, orders, levels, mode)
    spots = [(level, band) for level in range(1, levels + 1) for band in BANDS[1:]] + [(levels, "ll")]
    # of each basis: the side of each level, and the first place of each level's bands
    side = {o: [0, *(met[level][o] for level in range(1, levels + 1))] for o in orders}
    first, places = {}, {}
    for o in orders:
        ends = np.cumsum([0] + [side[o][level] ** 2 for level, _ in spots]).tolist()
        first[o] = dict(zip(spots, ends))
        places[o] = ends[-1]
    n = F.col("n")
    table = [(o, level, band, side[o][level], first[o][level, band]) for o in orders for level, band in spots]
    known = F.broadcast(coefficients.sparkSession.createDataFrame(table, "basis int, level int, band string, n int, first int"))
    inside = F.col("y").between(0, n - 1) & F.col("x").between(0, n - 1)
    place = F.when(inside, F.col("first") + F.col("y") * n + F.col("x")).otherwise(-1).cast("int")
    rows = coefficients.join(known, ["basis", "level", "band"]).select("basis", "vec_id", place.alias("place"), F.col("v").cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o, ids, sums in _gathered(batches, places):
            for names, found in _kinds(ids, sums):
                parts = [found] if isinstance(found, np.ndarray) else found
                words = {s: _Planes(*(a[:, first[o][s] : first[o][s] + side[o][s[0]] ** 2].reshape(-1, side[o][s[0]], side[o][s[0]]) for a in parts)) for s in spots}
                with np.errstate(invalid="ignore", over="ignore"):
                    yield _rows(names, {"basis": (o, pa.int32())}, _image(words, o, size, levels, mode))

    schema = f"vec_id {dict(coefficients.dtypes)['vec_id']}, basis int, y int, x int, v double"
    return rows.repartition("vec_id").sortWithinPartitions("basis", "vec_id").mapInArrow(run, schema)


def _checked(size: int, levels: int, mode: str) -> None:
    if size > WHOLE:
        raise ValueError(f"an image has at most {WHOLE} pixels a side")
    sides_fit(size, levels, mode)


def resynthesised(images: DataFrame, orders: list[int], size: int, levels: int = 1, mode: str = "periodic") -> DataFrame:
    """``synthesis`` of the images' ``analysis``, whose coefficients never are rows: vec_id, basis, y, x, v.  ``size`` is at most WHOLE."""
    _checked(size, levels, mode)

    def f(ids: pa.Array, p: _Planes) -> Iterator[pa.RecordBatch]:
        for o in orders:
            words = {(level, band): q for level, band, q in _words(p, o, size, levels, mode)}
            yield _rows(ids, {"basis": (o, pa.int32())}, _image(words, o, size, levels, mode))

    return _over_blocks(images, size, f"vec_id {dict(images.dtypes)['vec_id']}, basis int, y int, x int, v double", f)


def thresholded(images: DataFrame, size: int, levels: int, orders: list[int], threshold: float, mode: str = "periodic") -> DataFrame:
    """``from_dictionary`` of the soft threshold of ``dictionary``, whose coefficients never are rows: vec_id, y, x, v.  ``size`` is at most WHOLE."""
    _checked(size, levels, mode)
    scale = 1 / math.sqrt(len(orders) + 1)
    soft = lambda z: np.sign(z) * np.maximum(np.abs(z) - threshold, 0.0)

    def f(ids: pa.Array, p: _Planes) -> Iterator[pa.RecordBatch]:
        made = []
        for o in orders:
            words = {(level, band): q._replace(z=soft(q.z * scale)) for level, band, q in _words(p, o, size, levels, mode)}
            made.append(_image(words, o, size, levels, mode))
        masks = [] if p.there is None else [np.any([m[k] for m in made], axis=0) for k in (1, 2)]
        yield _rows(ids, {}, _Planes(sum(m.z for m in made), *masks))

    made = _over_blocks(images, size, f"vec_id {dict(images.dtypes)['vec_id']}, y int, x int, v double", f)
    own = images.select("vec_id", "y", "x", C.soft(F.col("v") * scale, threshold).alias("v"))
    return made.unionByName(own).groupBy("vec_id", "y", "x").agg((F.sum("v") * scale).alias("v"))


def band_sums(images: DataFrame, size: int, levels: int, orders: list[int], mode: str = "periodic", weight: Callable[[Any, Any], Any] | None = None) -> DataFrame:
    """Of each band of ``dictionary``: vec_id, basis, level, band, n, energy, moment (sum of values times ``weight`` of y and x, arrays or columns).

    The coefficients of the wavelets never are rows.  ``size`` is at most WHOLE.
    """
    _checked(size, levels, mode)
    scale = 1 / math.sqrt(len(orders) + 1)

    def f(ids: pa.Array, p: _Planes) -> Iterator[pa.RecordBatch]:
        for o in orders:
            for level, band, q in _words(p, o, size, levels, mode):
                axis = np.arange(q.z.shape[-1])
                w = np.ones((len(axis), len(axis))) if weight is None else weight(axis[:, None], axis[None, :])
                z = q.z.reshape(len(q.z), -1) * scale
                n, none, has = np.full(len(z), z.shape[1]), None, slice(None)
                if q.there is None:
                    energy, moment = (z * z).sum(axis=1), z @ w.ravel()
                else:
                    there, known = (m.reshape(len(z), -1) for m in (q.there, q.known))
                    z = np.where(known, z, 0.0)
                    n, none, has = there.sum(axis=1), ~known.any(axis=1), there.any(axis=1)
                    energy, moment = (z * z).sum(axis=1), (z * w.ravel()).sum(axis=1)
                columns = [pa.array(n.astype(np.int64)), pa.array(energy, mask=none), pa.array(moment, mask=none)]
                same = [pa.repeat(pa.scalar(value, kind), len(z)) for value, kind in _band(o, level, band).values()]
                found = pa.RecordBatch.from_arrays([ids, *same, *columns], ["vec_id", "basis", "level", "band", "n", "energy", "moment"])
                yield found if q.there is None else found.filter(pa.array(has))

    kind = dict(images.dtypes)["vec_id"]
    sums = _over_blocks(images, size, f"vec_id {kind}, basis int, level int, band string, n bigint, energy double, moment double", f)
    v, w = F.col("v") * scale, F.lit(1.0) if weight is None else weight(F.col("y"), F.col("x"))
    own = images.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(v * v).alias("energy"), F.sum(v * w).alias("moment"))
    return sums.unionByName(own.select("vec_id", F.lit(DIRAC).alias("basis"), F.lit(0).alias("level"), F.lit("dirac").alias("band"), "n", "energy", "moment"))


def dictionary(images: DataFrame, size: int, levels: int, orders: list[int], mode: str = "periodic") -> DataFrame:
    """Coefficients in all bases and the Dirac basis (number 0), each scaled by 1 / sqrt(number of bases)."""
    scale = 1 / math.sqrt(len(orders) + 1)
    own = images.select("vec_id", F.lit(DIRAC).alias("basis"), F.lit(0).alias("level"), F.lit("dirac").alias("band"), "y", "x", "v")
    return analysis(images, orders, size, levels, mode).unionByName(own).withColumn("v", F.col("v") * scale)


def from_dictionary(words: DataFrame, size: int, levels: int, orders: list[int], mode: str = "periodic") -> DataFrame:
    """Adjoint of ``dictionary``: the bases' images are summed and scaled alike, which gives an unchanged image back."""
    scale = 1 / math.sqrt(len(orders) + 1)
    own = words.where(F.col("basis") == DIRAC).select("vec_id", "basis", "y", "x", "v")
    both = synthesis(words, orders, size, levels, mode).unionByName(own)
    return both.groupBy("vec_id", "y", "x").agg((F.sum("v") * scale).alias("v"))


def padded(signals: DataFrame, size: int, left: int, right: int, mode: str) -> DataFrame:
    """Signals (vec_id, i, v) extended to -left .. size + right - 1: zero, constant (edge), periodic, reflect or symmetric.

    Each sample makes only the places that show it, so the rows made are the rows returned.
    """
    i, last = F.col("i"), size - 1
    before = F.sequence(F.lit(-left), F.lit(-1)) if left else F.array().cast("array<int>")
    after = F.sequence(F.lit(size), F.lit(last + right)) if right else F.array().cast("array<int>")
    none = F.array().cast("array<int>")
    if mode in ("zero", "constant"):
        edge = F.concat(F.when(i == 0, before).otherwise(none), F.when(i == last, after).otherwise(none))
        if mode == "constant":
            return signals.select("vec_id", F.explode(F.concat(F.array(i.cast("int")), edge)).alias("i"), "v")
        return signals.select("vec_id", F.explode(edge).alias("i"), F.lit(0.0).alias("v")).unionByName(signals.select("vec_id", i.cast("int").alias("i"), "v"))
    # the copies of a sample: sign * i + shift, with shifts of whole periods
    period, mirror = {"periodic": (size, None), "symmetric": (2 * size, -1), "reflect": (max(1, 2 * size - 2), 0)}[mode]
    shifts = [k * period for k in range(-(left // period) - 1, (last + right) // period + 2)]
    copies = [i + s for s in shifts] + ([] if mirror is None else [F.lit(s + mirror) - i for s in shifts])
    shown = F.filter(F.array_distinct(F.array(*[c.cast("int") for c in copies])), lambda at: (at >= -left) & (at <= last + right))
    return signals.select("vec_id", F.explode(shown).alias("i"), "v")


def oriented(images: DataFrame, size: int, turns: str = "turns", flip: str = "flip", back: bool = False) -> DataFrame:
    """Images mirrored left to right where ``flip`` and then turned by ``turns`` quarter turns; ``back`` undoes it."""
    last = size - 1
    y, x = F.col("y"), F.col("x")
    t = F.pmod(-F.col(turns) if back else F.col(turns), F.lit(4))
    mirrored = lambda c: F.when(F.col(flip), last - c).otherwise(c)
    x0 = x if back else mirrored(x)
    ny = F.when(t == 0, y).when(t == 1, last - x0).when(t == 2, last - y).otherwise(x0)
    nx = F.when(t == 0, x0).when(t == 1, y).when(t == 2, last - x0).otherwise(last - y)
    return images.withColumns({"y": ny.cast("int"), "x": (mirrored(nx) if back else nx).cast("int")})
