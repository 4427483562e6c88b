"""Random rank-one projections of visibilities under random signs, their adjoints, and images from projected data.

A projection p of the visibilities y of one snapshot and channel is the sum over antenna pairs of conj(alpha_p[ant1]) y beta_p[ant2].
Modulation sums projections over channels and then over snapshots under random signs.  Data of any size become ``count`` times
``snapshot_signs`` times ``channel_signs`` numbers, and the adjoint takes these back to rows, from which the usual adjoint sum makes an image.

All random numbers come from a counter-based generator: integer arithmetic on (seed, antenna, projection, snapshot, channel)
that is one SQL expression, the same in any engine, partitioning and retry.  Nothing random is stored or joined.

Forward sums are built-in expressions that combine before the shuffle.  In the adjoint, the ``count`` numbers of a snapshot and
channel are one array (a small table, one row a snapshot and channel) that meets the rows in an ordinary join; an Arrow batch of these is
one array operation, and rows are not multiplied.  Rows with a null value take no part in sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.operators import fourier

MODULUS = 2147483647  # a prime, so that products of two residues fit 64 bits
FACTORS = [7919, 104729, 611953, 746773, 882377, 1299709]
STEPS = [48271, 69621]


def draw(*parts: int | str) -> str:
    """SQL of a number from 0 to MODULUS - 1 that depends on all parts: whole numbers from 0 on, or names of such columns."""
    h = "((" + " + ".join(f"cast({p} as bigint) * {f}" for p, f in zip(parts, FACTORS, strict=False)) + f") % {MODULUS})"
    for c in STEPS:
        h = f"(({h} * ({h} + {c})) % {MODULUS})"
    return h


def drawn(*parts: int | np.ndarray) -> np.ndarray:
    """The number of ``draw`` for arrays of parts."""
    h = sum((np.asarray(p, np.int64) * f for p, f in zip(parts, FACTORS, strict=False)), np.int64(0)) % MODULUS
    for c in STEPS:
        h = (h * (h + c)) % MODULUS
    return h


def seed_of(path: Column, fixed: int = 0) -> Column:
    """Seed of a file from the number after ``_id_`` in its name, 1 where there is none; ``fixed``, if not 0, for all files."""
    if fixed:
        return F.lit(fixed)
    return F.coalesce(F.regexp_extract(path, "_id_([^_]*)", 1).try_cast("int"), F.lit(1))


@dataclass(frozen=True)
class Projection:
    """Numbers of projections, snapshots, channels and of signs for each of these, and how vectors are drawn.

    ``same`` takes one vector for both antennas of a pair.  ``vary`` says for what vectors are drawn anew: "each" snapshot and
    channel, each "channel", or once for "all".  ``kind`` is "unitary" (modulus 1) or "gaussian" (complex, mean square 1).
    ``seed`` is one number for all rows; files of several seeds are projected apart.
    """

    count: int
    snapshots: int
    channels: int
    snapshot_signs: int = 1
    channel_signs: int = 1
    seed: int = 1
    same: bool = False
    vary: str = "each"
    kind: str = "unitary"

    def __post_init__(self):
        if min(self.count, self.snapshots, self.channels, self.snapshot_signs, self.channel_signs) < 1:
            raise ValueError("sizes are positive")
        if self.vary not in ("each", "channel", "all") or self.kind not in ("unitary", "gaussian"):
            raise ValueError(f"unknown vary {self.vary!r} or kind {self.kind!r}")

    def _parts(self, side: int, use: int) -> tuple:
        """What a number depends on besides antenna and projection."""
        t, ch = {"each": ("t", "ch"), "channel": (0, "ch"), "all": (0, 0)}[self.vary]
        return t, ch, self.seed, (0 if self.same else side) + 2 * use

    def _drawn(self, ant: str, p: str, side: int, use: int) -> str:
        return draw(ant, p, *self._parts(side, use))

    def phase(self, p: str = "p") -> str:
        """SQL of the angle of conj(alpha_p[ant1]) beta_p[ant2]."""
        return f"(({self._drawn('ant2', p, 1, 0)} - {self._drawn('ant1', p, 0, 0)}) * {2 * math.pi / MODULUS!r})"

    def size(self, p: str = "p") -> str:
        """SQL of its modulus."""
        if self.kind == "unitary":
            return "1e0"
        power = lambda ant, side: f"-ln(({self._drawn(ant, p, side, 1)} + 0.5e0) / {float(MODULUS)!r})"
        return f"sqrt({power('ant1', 0)} * {power('ant2', 1)})"

    def coefficients(self, p: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        """conj(alpha_p[ant1]) beta_p[ant2] for arrays of p and of the named columns."""
        of = lambda side, use: drawn(rows[("ant1", "ant2")[side]], p, *[rows[x] if isinstance(x, str) else x for x in self._parts(side, use)])
        c = np.exp(1j * (of(1, 0) - of(0, 0)) * (2 * math.pi / MODULUS))
        if self.kind == "gaussian":
            c *= np.sqrt(np.log((of(0, 1) + 0.5) / MODULUS) * np.log((of(1, 1) + 0.5) / MODULUS))
        return c

    def sign(self, m: str, of: str, use: int) -> str:
        """SQL of the sign of modulation ``m`` for a snapshot (use 0) or channel (use 1)."""
        return f"(CASE WHEN {draw(m, of, use, self.seed, 5)} % 2 = 0 THEN 1e0 ELSE -1e0 END)"

    @property
    def correction(self) -> float:
        """Factor of the weights that keeps the expected energy of what is projected, for independent vectors and signs.

        One over the square root of the number of values, and of the channels as well where all share their vectors.
        """
        values = self.count * self.snapshot_signs * self.channel_signs
        return 1 / math.sqrt(values * (self.channels if self.vary == "all" else 1))


def _numbered(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _sums(rows: DataFrame, re: str, im: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.expr(re)).alias("re"), F.sum(F.expr(im)).alias("im"))


def projected(vis: DataFrame, spec: Projection) -> DataFrame:
    """Rows (t, ch, ant1, ant2, re, im) -> t, ch, p, re, im."""
    rows = vis.select("t", "ch", "ant1", "ant2", "re", "im", _numbered(spec.count).alias("p"))
    rows = rows.select("t", "ch", "p", "re", "im", F.expr(spec.phase()).alias("a"), F.expr(spec.size()).alias("s"))
    return _sums(rows, "s * (re * cos(a) - im * sin(a))", "s * (re * sin(a) + im * cos(a))", "t", "ch", "p")


def modulated(values: DataFrame, spec: Projection) -> DataFrame:
    """Rows (t, ch, p, re, im) -> p, mb, mk, re, im: sums over channels and then over snapshots under random signs."""
    over = values.select("t", "ch", "p", "re", "im", _numbered(spec.channel_signs).alias("mk")).withColumn("s", F.expr(spec.sign("mk", "ch", 1)))
    part = _sums(over, "s * re", "s * im", "t", "p", "mk")
    over = part.select("t", "p", "mk", "re", "im", _numbered(spec.snapshot_signs).alias("mb")).withColumn("s", F.expr(spec.sign("mb", "t", 0)))
    return _sums(over, "s * re", "s * im", "p", "mb", "mk")


def demodulated(values: DataFrame, spec: Projection) -> DataFrame:
    """Adjoint of ``modulated``: rows (p, mb, mk, re, im) -> t, ch, p, re, im for every snapshot and channel."""
    over = values.select("p", "mb", "mk", "re", "im", _numbered(spec.channels).alias("ch")).withColumn("s", F.expr(spec.sign("mk", "ch", 1)))
    part = _sums(over, "s * re", "s * im", "p", "mb", "ch")
    over = part.select("p", "mb", "ch", "re", "im", _numbered(spec.snapshots).alias("t")).withColumn("s", F.expr(spec.sign("mb", "t", 0)))
    return _sums(over, "s * re", "s * im", "t", "ch", "p")


def back_projected(vis: DataFrame, values: DataFrame, spec: Projection) -> DataFrame:
    """Adjoint of ``projected``: ``vis`` with re, im taken from the values (t, ch, p, re, im); zero where there are none."""
    arrays = values.groupBy("t", "ch").agg(F.collect_list(F.struct("p", "re", "im")).alias("_values"))  # ``count`` values each
    rows = vis.drop("re", "im").join(arrays, ["t", "ch"], "left")
    names = [c for c in rows.columns if c != "_values"]
    rows = rows.select(*names, F.coalesce("_values", F.array().cast(rows.schema["_values"].dataType)).alias("_values"))
    used = ("ant1", "ant2", "t", "ch")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", re double, im double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names))
            row, e = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            at = {c: b.column(names.index(c)).to_numpy().astype(np.int64)[row] for c in used}
            c = np.conj(spec.coefficients(e.field("p").to_numpy(), at)) * (e.field("re").to_numpy() + 1j * e.field("im").to_numpy())
            sums = [pa.array(np.bincount(row, part, b.num_rows).astype(np.float64)) for part in (c.real, c.imag)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *sums], [*names, "re", "im"])

    return rows.mapInArrow(run, schema)


def measured(vis: DataFrame, spec: Projection) -> DataFrame:
    """p, mb, mk, re, im of the weighted rows (t, ch, ant1, ant2, re, im, weight), with the correction of the weights."""
    w = F.col("weight") * spec.correction
    return modulated(projected(vis.withColumns({"re": w * F.col("re"), "im": w * F.col("im")}), spec), spec)


def gridless(vis: DataFrame, values: DataFrame, spec: Projection) -> DataFrame:
    """Adjoint of ``measured``: rows with re, im, and the weight still to be applied by the image's adjoint sum."""
    rows = back_projected(vis, demodulated(values, spec), spec)
    return rows.withColumn("weight", F.col("weight") * spec.correction)


def dirty_image(vis: DataFrame, side: int, spec: Projection) -> DataFrame:
    """y, x, dirty, psf of projected data: rows (t, ch, ant1, ant2, u, v, re, im, weight) go forward and back.

    ``psf`` is what a point source of unit flux in the middle gives.
    """
    point = vis.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})
    images = [fourier.dirty_image(gridless(vis, measured(rows, spec), spec), side).select("y", "x", F.col("dirty").alias(name)) for rows, name in ((vis, "dirty"), (point, "psf"))]
    return images[0].join(images[1], ["y", "x"])
