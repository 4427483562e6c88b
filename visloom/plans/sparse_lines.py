"""Sparse reconstruction of images of any side as a Spark iteration: no task and no driver holds an image.

The model is a table of lines (``tiled``), the wavelet dual a table of facets (``facets``).  A round is two jobs:

1. Each line sends pieces of its transform to blocks of the kernel's spectrum, and its pixels to the facets that reach them.  A block
   multiplies by the spectrum; a facet renews its dual.  Both send back what they give to each line, and the result is written.
2. Lines gather what they are given: the kernel applied to the model, and the dual's synthesis.

The step itself, x <- max(0, x - tau (data gradient + synthesis of the dual)), is a column expression.  All images go through a round
together; the driver holds a few numbers an image.  Groups are BLOCK spectrum lines, one facet, or LINES image lines, so they
grow with an image's side, never with the rows or the number of images.

Two problems are solved by the same rounds (a primal-dual splitting, whose limit is that of the loops with an inner proximity step):

* ``radius`` None: half the weighted squared misfit plus a weighted l1 norm of the coefficients, over nonnegative images.
* else: the l1 norm over nonnegative images whose weighted residual norm is at most ``radius``.  The dual value per visibility is the
  forward map of an image less a multiple of the data, so its norm follows from the kernel, and no round reads the rows.

Weights floor / (floor + |coefficient|) are renewed after each inner solution.  Rows with a null in a key or value take no part; no rows
give no image; an image whose weights are all zero is left out, as nothing is known of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.operators.facets import Words
from visloom.operators.tiled import BLOCK, _complex, _lists, _schema, _spectrum, dirty_lines
from visloom.plans.solvers import Rounds, pick
from visloom.storage import discard, noting, written

Denoiser = Callable[[np.ndarray, float], np.ndarray]
LINES = 32
BATCH = 512  # lines an Arrow batch
TAU, SIGMA = 0.99, 0.5  # of the primal step and of each dual's, for a kernel of norm 1: 1 / TAU >= 1 covers both problems


def _real(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _reals(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def _same(value: int, count: int) -> pa.Array:
    return pa.array(np.full(count, value, np.int32))


@dataclass(frozen=True)
class _Plan:
    """One problem's sizes and the jobs of its rounds."""

    keys: tuple[str, ...]
    words: Words
    margin: int | None = None  # of facets that a denoiser sees, cut at the image's ends; None: those of the words

    @property
    def side(self) -> int:
        return self.words.side

    def window(self, start: int, width: int) -> np.ndarray:
        """Places along an axis that a facet is sent."""
        if self.margin is None:
            return (start + np.arange(width + self.words.reach)) % self.side
        return np.arange(max(0, start - self.margin), min(self.side, start + width + self.margin))

    def sent(self, lines: DataFrame, spectral: bool = True, faceted: bool = True) -> DataFrame:
        """(keys, kind, a, b, line, v): x to block a of the spectrum (kind 0), bar to facet (a, b) (kind 1), from lines (keys, line, x, bar)."""
        keys, words, side = list(self.keys), self.words, self.side
        names = [*keys, "kind", "a", "b", "line", "v"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                heads, line = batch.columns[: len(keys)], batch.column(len(keys))
                if spectral:
                    z = np.fft.fft(_real(batch.column(len(keys) + 1)), 2 * side, axis=1)
                    for k in range(0, 2 * side, BLOCK):
                        place = [_same(n, batch.num_rows) for n in (0, k // BLOCK, 0)]
                        yield pa.RecordBatch.from_arrays([*heads, *place, line, _lists(z[:, k : k + BLOCK])], names)
                bar = _real(batch.column(len(keys) + 2))
                for a, (s, w) in enumerate(words.facets if faceted else ()):
                    at = np.nonzero(np.isin(line.to_numpy(), self.window(s, w)))[0]
                    own = [c.take(pa.array(at)) for c in (*heads, line)]
                    for b, (t, h) in enumerate(words.facets if len(at) else ()):
                        place = [_same(n, len(at)) for n in (1, a, b)]
                        yield pa.RecordBatch.from_arrays([*own[:-1], *place, own[-1], _reals(bar[at][:, self.window(t, h)])], names)

        return lines.select(*keys, "line", "x", "bar").mapInArrow(run, _schema(lines, keys, "kind int, a int, b int, line int, v array<double>"))

    def answered(self, pieces: DataFrame, held: DataFrame, renew: bool = False, denoiser: Denoiser | None = None) -> DataFrame:
        """(keys, role, a, b, line, at, v, w, lam): for lines, of the kernel (role 0) and of the dual (role 1); and the facets' new duals (role 2).

        ``held``: (keys, kind, a, b, line, v, w, lam), the spectrum's lines and the facets' duals with bounds.  With ``renew``
        facets leave their dual and set the bounds from the coefficients instead.  With a denoiser facets have no dual: v holds the
        image's scale and noise level, and lines get the facet's own pixels as the denoiser gives them.
        """
        keys, words, side = list(self.keys), self.words, self.side
        names = [*keys, "role", "a", "b", "line", "at", "v", "w", "lam"]

        def rows(key: tuple, role: int, line: np.ndarray, at: int, v: pa.Array, w: pa.Array | None = None, lam: float | None = None) -> pa.Table:
            n = len(line)
            same = [pa.array([k.as_py()] * n, k.type) for k in key[: len(keys)]]
            place = [_same(role, n), *(_same(k.as_py(), n) for k in key[len(keys) + 1 :])]
            w = pa.nulls(n, pa.list_(pa.float64())) if w is None else w
            return pa.Table.from_arrays([*same, *place, pa.array(line.astype(np.int32)), _same(at, n), v, w, pa.array([lam] * n, pa.float64())], names)

        def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            first = key[len(keys) + 1].as_py() * BLOCK
            wide = min(BLOCK, 2 * side - first)
            z, s = np.zeros((wide, side), complex), np.zeros((wide, 2 * side), complex)
            z[:, left.column("line").to_numpy()] = _complex(left.column("v").chunk(0)).T
            s[right.column("line").to_numpy() - first] = _complex(right.column("v").chunk(0))
            out = np.fft.ifft(np.fft.fft(z, 2 * side, axis=1) * s, axis=1)[:, :side]
            return rows(key, 0, np.arange(side), first, _lists(out.T))

        def facet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            (s, w), (t, h) = (words.facets[k.as_py()] for k in key[len(keys) + 1 :])
            reached = self.window(s, w)
            place = np.zeros(side, np.int64)
            place[left.column("line").to_numpy()] = np.arange(left.num_rows)
            pixels = _real(left.column("v").chunk(0))[place[reached]]
            if denoiser is not None:
                scale, sigma = right.column("v").chunk(0).flatten().to_pylist()
                inner = (denoiser(pixels / scale, sigma) * scale)[s - reached[0] :, t - self.window(t, h)[0] :][:w, :h]
                return rows(key, 1, np.arange(s, s + w), t, _reals(np.maximum(inner, 0)))
            found = words.analysis(pixels, w, h).ravel()
            dual, bound = (right.column(c).chunk(0).flatten().to_numpy() for c in ("v", "w"))
            lam = right.column("lam")[0].as_py()
            if renew:
                floor = lam * 1.98
                bound = lam * floor / (floor + np.abs(found))
                return rows(key, 2, np.zeros(1), 0, _reals(dual[None]), _reals(bound[None]), lam)
            dual = np.clip(dual + SIGMA * found, -bound, bound)
            back = words.adjoint(dual.reshape(-1, w, h), w, h)
            lines, which = np.unique(reached, return_inverse=True)
            folded = np.zeros((len(lines), back.shape[1]))
            np.add.at(folded, which, back)
            return pa.concat_tables([rows(key, 1, lines, t, _reals(folded)), rows(key, 2, np.zeros(1), 0, _reals(dual[None]), _reals(bound[None]), lam)])

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            if not left.num_rows or not right.num_rows:  # of an image that is left out
                return rows(key, 0, np.zeros(0), 0, _reals(np.zeros((0, 1))))
            return (facet if key[len(keys)].as_py() else block)(key, left, right)

        by = [*keys, "kind", "a", "b"]
        schema = _schema(pieces, keys, "role int, a int, b int, line int, at int, v array<double>, w array<double>, lam double")
        return pieces.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(run, schema)

    def gathered(self, answers: DataFrame, state: DataFrame) -> DataFrame:
        """The lines of ``state`` with the kernel applied to x (kx) and the dual's synthesis (psi)."""
        keys, side, own = list(self.keys), self.side, state.columns

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.combine_chunks()
            line = right.column("line").to_numpy()
            place = np.zeros(side, np.int64)
            place[line] = np.arange(len(line))
            z, psi = np.zeros((len(line), 2 * side), complex), np.zeros((len(line), side))
            if left.num_rows and len(line):
                lists = left.column("v").chunk(0)
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                for i, (role, to, at) in enumerate(zip(*(left.column(c).to_pylist() for c in ("role", "line", "at")))):
                    v = flat[ends[i] : ends[i + 1]]
                    if role:
                        np.add.at(psi[place[to]], (at + np.arange(len(v))) % side, v)
                    else:
                        z[place[to], at : at + len(v) // 2] = v.view(complex)
            kx = np.fft.ifft(z, axis=1)[:, :side].real
            lists = pa.list_(pa.float64())  # values that Spark knows to be never null have another type
            same = [right.column(c) if c in (*keys, "line") else right.column(c).cast(lists) for c in own]
            return pa.Table.from_arrays([*same, _reals(kx), _reals(psi)], [*own, "kx", "psi"])

        part = F.floor(F.col("line") / LINES).cast("int").alias("part")
        left = answers.where("role < 2").select(*keys, part, "role", "line", "at", "v")
        schema = ", ".join([*(f"`{c}` {t}" for c, t in state.dtypes), "kx array<double>, psi array<double>"])
        by = [*keys, part]
        return left.groupBy(*keys, "part").cogroup(state.groupBy(*by)).applyInArrow(run, schema)

    def each(self, formula: str) -> Column:
        """A line whose values are ``formula`` at i."""
        return F.expr(f"transform(sequence(0, {self.side - 1}), i -> {formula})")

    def dot(self, formula: str) -> Column:
        return F.sum(F.expr(f"aggregate(sequence(0, {self.side - 1}), 0D, (acc, i) -> acc + {formula})"))


def _prepared(rows: DataFrame, plan: _Plan, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spectrum and dirty lines for a kernel of norm at most 1, and (keys, top, lam, peak) of each image.

    ``top`` bounds the kernel's norm from above: it is the largest value of the spectrum of the periodic kernel around it.
    """
    keys, side = list(plan.keys), plan.side
    found = written(dirty_lines(rows, 2 * side, keys, {"dirty": ("re", "im"), "kernel": ("weight", None), "square": ("square", None)}), "sparse-dirty")
    kernels = found.where(F.col("what") != "dirty")
    spectrum = written(_spectrum(kernels, [*keys, "what"], side), "sparse-spectrum")
    largest = F.expr(f"sqrt(array_max(transform(sequence(0, {2 * side - 1}), i -> v[2 * i] * v[2 * i] + v[2 * i + 1] * v[2 * i + 1])))")
    top = lambda what: F.max(F.when(F.col("what") == what, largest))
    tops = spectrum.groupBy(*keys).agg(top("kernel").alias("top"), top("square").alias("square")).where("top > 0")
    peaks = kernels.where((F.col("what") == "kernel") & (F.col("line") == side)).select(*keys, F.col("v")[2 * side].alias("peak"))
    noise = scale / F.sqrt(2 * F.col("top")) * F.sqrt(F.col("square") / F.col("top"))
    images = written(tops.join(peaks, keys).select(*keys, "top", (noise * plan.words.scale / 1.98).alias("lam"), "peak"), "sparse-images")
    first = side - side // 2
    blocks = spectrum.where(F.col("what") == "kernel").join(images, keys)
    blocks = blocks.select(*keys, F.lit(0).alias("kind"), F.floor(F.col("line") / BLOCK).cast("int").alias("a"), F.lit(0).alias("b"), "line", F.expr("transform(v, s -> s / top)").alias("v"), F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("double").alias("lam"))
    lines = found.where((F.col("what") == "dirty") & F.col("line").between(first, first + side - 1)).join(images, keys)
    dirty = lines.select(*keys, (F.col("line") - first).cast("int").alias("line"), plan.each(f"v[2 * (i + {first})] / top").alias("d"))
    return written(blocks, "sparse-blocks"), written(dirty, "sparse-lines"), images


def _duals(images: DataFrame, plan: _Plan) -> DataFrame:
    """A dual of zero under the bound lam for each image and facet."""
    words, spark = plan.words, images.sparkSession
    many = len(words.facets)
    place = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("b"))
    wide = lambda c: F.when(F.col(c) == many - 1, words.facets[-1][1]).otherwise(words.facets[0][1])
    size = ((len(words.orders) + 1) * wide("a") * wide("b")).cast("int")
    return place.select(*plan.keys, F.lit(1).alias("kind"), "a", "b", F.lit(0).alias("line"), F.array_repeat(F.lit(0.0), size).alias("v"), F.array_repeat(F.col("lam"), size).alias("w"), "lam")


def _held(blocks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    duals = answers.where("role = 2").select(*keys, F.lit(1).alias("kind"), "a", "b", "line", "v", "w", "lam")
    return blocks.unionByName(duals)


class _Ball:
    """The dual of the data under a bound on each image's residual norm: forward(a) - times * data, of which lines keep a and ka.

    The trial dual is the old one plus ``sigma`` (forward(2 x - x') - data); projection on the ball leaves a part of it.
    """

    def __init__(self, rows: DataFrame, images: DataFrame, plan: _Plan, radius: float, sigma: float, slack: float):
        self.plan, self.sigma, self.slack = plan, sigma, slack
        by = list(plan.keys)
        power = F.sum(F.col("weight") * (F.col("re") ** 2 + F.col("im") ** 2))
        values = rows.na.drop(subset=["u", "v", "re", "im", "weight"]).groupBy(*by).agg(power.alias("energy"))
        found = values.join(images, by).collect()  # one row an image
        self.energy = {tuple(r[k] for k in by): r["energy"] / r["top"] for r in found}
        self.bound = {tuple(r[k] for k in by): radius / math.sqrt(r["top"]) for r in found}
        self.times = dict.fromkeys(self.energy, 0.0)
        self.number = _schema(images, by, "keep double, times double")

    def renewed(self, own: DataFrame) -> tuple[DataFrame, dict[tuple, bool]]:
        """Lines (x, xp, kx, kxp, a, ka, d) with the new a and ka and the data gradient g; and which images are within the bound."""
        plan, sigma, by = self.plan, self.sigma, list(self.plan.keys)
        after = own.withColumns({"a": plan.each(f"a[i] + {sigma} * (2 * x[i] - xp[i])"), "ka": plan.each(f"ka[i] + {sigma} * (2 * kx[i] - kxp[i])")})
        sums = {"aka": "a[i] * ka[i]", "ad": "a[i] * d[i]", "xkx": "x[i] * kx[i]", "xd": "x[i] * d[i]"}
        within, kept = {}, {}
        for r in after.groupBy(*by).agg(*[plan.dot(f).alias(c) for c, f in sums.items()]).collect():  # one row an image
            k = tuple(r[c] for c in by)
            e, n = self.energy[k], self.times[k] + sigma
            length = math.sqrt(max(0.0, r["aka"] - 2 * n * r["ad"] + n * n * e))
            kept[k] = 1 - min(1.0, sigma * self.bound[k] / length) if length else 0.0
            self.times[k] = kept[k] * n
            within[k] = math.sqrt(max(0.0, r["xkx"] - 2 * r["xd"] + e)) <= self.bound[k] * (1 + self.slack)
        small = F.broadcast(own.sparkSession.createDataFrame([(*k, kept[k], self.times[k]) for k in kept], self.number))  # one row an image
        after = after.join(small, by).withColumns({"a": plan.each("keep * a[i]"), "ka": plan.each("keep * ka[i]")})
        return after.withColumn("g", plan.each("ka[i] - times * d[i]")), within


def _moved(state: DataFrame, plan: _Plan, since: str, tolerance: float) -> tuple[dict[tuple, bool], dict[tuple, float]]:
    """Of each image, whether its relative variation since another column is below the tolerance, and its largest pixel."""
    by = list(plan.keys)
    sums = [plan.dot(f"(x[i] - {since}[i]) * (x[i] - {since}[i])").alias("gap"), plan.dot("x[i] * x[i]").alias("size"), F.max(F.array_max("x")).alias("top")]
    found = {tuple(r[k] for k in by): r for r in state.groupBy(*by).agg(*sums).collect()}  # one row an image
    return {k: math.sqrt(r["gap"]) < tolerance * (math.sqrt(r["size"]) + 1e-10) for k, r in found.items()}, {k: r["top"] for k, r in found.items()}


def _renamed(vis: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with keys under names that clash with no column of the loops; rows with a null key are left out."""
    used = {"y", "x", "dirty", "model", "residual", "rounds", "solutions", "settled", "sigma"} & {k.lower() for k in keys}
    if used:
        raise ValueError(f"keys may not be named like results: {sorted(used)}")
    by = [f"key_{i}" for i in range(len(keys))] or ["key_0"]
    given = [F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("key_0")]
    return vis.select(*given, "u", "v", "re", "im", "weight").na.drop(subset=by), by


def _result(last: DataFrame, images: DataFrame, plan: _Plan, ended: DataFrame, names: list[str]) -> DataFrame:
    """Long pixels of lines (x, d, kx) with the columns of ``ended``, one row an image."""
    by, half = list(plan.keys), plan.side // 2
    kept = [c for c in ended.columns if c not in by]
    pixel = F.explode(F.expr(f"transform(sequence(0, {plan.side - 1}), i -> named_struct('y', i - {half}, 'd', d[i], 'x', x[i], 'k', kx[i]))")).alias("p")
    rows = last.join(images, by).join(F.broadcast(ended), by).select(*by, (F.col("line") - half).alias("x"), "top", "peak", *kept, pixel)
    over = F.col("top") / F.col("peak")
    given = [F.col(b).alias(k) for b, k in zip(by, names)]
    return rows.select(*given, "p.y", "x", (F.col("p.d") * over).alias("dirty"), F.col("p.x").alias("model"), ((F.col("p.d") - F.col("p.k")) * over).alias("residual"), *kept)


def sparse(vis: DataFrame, side: int, keys: list[str] = [], rounds: Rounds = Rounds(), radius: float | None = None, words: Words | None = None) -> DataFrame:
    """One image for each value of ``keys`` (one in all without keys) from rows (keys, u, v in [-pi, pi], re, im, weight).

    Returns keys, y, x, dirty, model, residual (both over the PSF peak), rounds (those of the last inner solution), solutions, settled.  An
    inner solution ends when every image's variation is below ``rounds.inner_tolerance`` (and its residual within the radius);
    ``settled`` tells whether that and the outer rule were met before the limits.
    """
    rows, by = _renamed(vis, keys)
    plan = _Plan(tuple(by), words or Words(side))
    if plan.side != side:
        raise ValueError("the words are of another side")
    with noting() as made:
        out = written(_solved(rows, plan, rounds, radius, keys), "sparse-image")
    discard(*[t for t in made if t is not out])
    return out


def _solved(rows: DataFrame, plan: _Plan, rounds: Rounds, radius: float | None, names: list[str]) -> DataFrame:
    by, spark = list(plan.keys), rows.sparkSession
    blocks, dirty, images = _prepared(rows, plan, rounds.noise_scale)
    zero = plan.each("0D")
    state = dirty.select(*by, "line", "d", *[zero.alias(c) for c in ("x", "xp", "x0")])
    ball = None
    if radius is not None:
        state = state.withColumns({c: zero for c in ("a", "ka", "kxp")})
        ball = _Ball(rows, images, plan, radius, SIGMA, rounds.inner_tolerance)
    held = blocks.unionByName(_duals(images, plan))
    solutions, done, settled, last = 0, 0, {}, None
    old: list[DataFrame] = []
    while solutions < rounds.outer and not (settled and all(settled.values())):
        inner, done = {}, 0
        while done < rounds.inner and not (inner and all(inner.values())):
            ready = state.withColumn("bar", plan.each("2 * x[i] - xp[i]"))
            answers = written(plan.answered(plan.sent(ready), held), "sparse-answers", batch=BATCH)
            own = written(plan.gathered(answers, state), "sparse-round", batch=BATCH)
            held = _held(blocks, answers, by)
            after, within = ball.renewed(own) if ball else (own.withColumn("g", plan.each("kx[i] - d[i]")), None)
            step = plan.each(f"greatest(0D, x[i] - {TAU} * (g[i] + psi[i]))")
            rest = ["a", "ka", F.col("kx").alias("kxp")] if ball else []
            state = after.withColumn("new", step).select(*by, "line", "d", F.col("new").alias("x"), F.col("x").alias("xp"), "x0", *rest)
            done, last = done + 1, own
            still, _ = _moved(state, plan, "xp", rounds.inner_tolerance)
            inner = {k: done >= rounds.least and v and (within is None or within[k]) for k, v in still.items()}
            discard(*old)
            old = [answers, own]
            if not inner:  # no image
                break
        solutions += 1
        still, _ = _moved(state, plan, "x0", rounds.outer_tolerance)
        settled = {k: inner[k] and v for k, v in still.items()}
        if not settled:
            break
        if solutions < rounds.outer and not all(settled.values()):
            answers = plan.answered(plan.sent(state.withColumn("bar", F.col("x")), spectral=False), held.where("kind = 1"), renew=True)
            answers = written(answers, "sparse-weights", batch=BATCH)
            held = _held(blocks, answers, by)
            state = state.withColumn("x0", F.col("x"))
            old.append(answers)
    ends = [(*k, done, solutions, bool(v)) for k, v in settled.items()]
    ended = spark.createDataFrame(ends, _schema(images, by, "rounds int, solutions int, settled boolean"))
    return _result(last, images, plan, ended, names)


def denoised(vis: DataFrame, side: int, shelf: list[float], denoiser: Denoiser, margin: int, keys: list[str] = [], rounds: Rounds = Rounds(), radius: float | None = None, peak_tolerance: float = 0.1, width: int = 128) -> DataFrame:
    """Images as in ``sparse``, with a denoiser from a shelf of noise levels as the proximity step; ``sigma`` is the level last used.

    ``denoiser(pixels, sigma)`` sees a facet of at most ``width`` pixels a side and ``margin`` pixels around it, scaled so that the noise
    heuristic equals sigma.  Where a pixel of its result depends on pixels at most ``margin`` away, the whole is what it gives for the
    image.  Without ``radius`` rounds are forward-backward steps, else primal-dual ones.  A level is chosen again when an image's
    peak settles outside the range of its level.
    """
    rows, by = _renamed(vis, keys)
    plan = _Plan(tuple(by), Words(side, (), 0, width), margin)
    with noting() as made:
        out = written(_denoised(rows, plan, shelf, denoiser, rounds, radius, peak_tolerance, keys), "denoised-image")
    discard(*[t for t in made if t is not out])
    return out


def _denoised(rows: DataFrame, plan: _Plan, shelf: list[float], denoiser: Denoiser, rounds: Rounds, radius: float | None, peak_tolerance: float, names: list[str]) -> DataFrame:
    by, spark = list(plan.keys), rows.sparkSession
    blocks, dirty, images = _prepared(rows, plan, rounds.noise_scale)
    zero, tau = plan.each("0D"), 1.98 if radius is None else 0.5
    state, ball = dirty.select(*by, "line", "d", zero.alias("x"), zero.alias("xp")), None
    if radius is not None:
        state = state.withColumns({c: zero for c in ("a", "ka", "kxp")})
        ball = _Ball(rows, images, plan, radius, 1.0, rounds.inner_tolerance)
    tops = dirty.groupBy(*by).agg(F.max(F.array_max("d")).alias("most")).join(images, by).collect()  # one row an image
    numbers = lambda r: tuple(r[k] for k in by)
    level = {numbers(r): r["lam"] * 1.98 for r in tops}  # words of no basis: the heuristic itself
    peaks = {numbers(r): max(r["most"] * r["top"] / r["peak"], 1e-10) for r in tops}
    chosen = {k: pick(shelf, level[k] / peaks[k]) for k in level}
    places = spark.createDataFrame([(a, b) for a in range(len(plan.words.facets)) for b in range(len(plan.words.facets))], "a int, b int")
    kinds = _schema(images, by, "v array<double>")
    done, settled, last, old = 0, {}, None, []
    while done < rounds.inner and not (settled and all(settled.values())):
        answers = written(plan.answered(plan.sent(state.withColumn("bar", F.col("x")), faceted=False), blocks), "denoised-kernel", batch=BATCH)
        own = written(plan.gathered(answers, state).drop("psi"), "denoised-round", batch=BATCH)
        after, within = ball.renewed(own) if ball else (own.withColumn("g", plan.each("kx[i] - d[i]")), None)
        rest = ["a", "ka", F.col("kx").alias("kxp")] if ball else []
        ready = after.select(*by, "line", "d", "x", plan.each(f"x[i] - {tau} * g[i]").alias("bar"), *rest)
        small = F.broadcast(spark.createDataFrame([(*k, [level[k] / c[0], c[0]]) for k, c in chosen.items()], kinds))  # one row an image
        facets = small.crossJoin(F.broadcast(places)).select(*by, F.lit(1).alias("kind"), "a", "b", F.lit(0).alias("line"), "v", F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("double").alias("lam"))
        smooth = written(plan.answered(plan.sent(ready, spectral=False), facets, denoiser=denoiser), "denoised-facets", batch=BATCH)
        new = written(plan.gathered(smooth, ready.drop("bar")).drop("kx"), "denoised-step", batch=BATCH)
        state = new.select(*by, "line", "d", F.col("psi").alias("x"), F.col("x").alias("xp"), *([c if isinstance(c, str) else "kxp" for c in rest]))
        done, last = done + 1, own
        still, most = _moved(state, plan, "xp", rounds.inner_tolerance)
        for k, (sigma, low, high) in chosen.items():
            top = max(most[k], 1e-10)
            steady, peaks[k] = abs(top - peaks[k]) < peak_tolerance * peaks[k], top
            if steady and not low <= level[k] / top < high:
                chosen[k] = pick(shelf, level[k] / top)
        settled = {k: done >= rounds.least and v and (within is None or within[k]) for k, v in still.items()}
        discard(*old)
        old = [answers, own, smooth, new]
        if not settled:  # no image
            break
    ends = [(*k, done, bool(v), chosen[k][0]) for k, v in settled.items()]
    ended = spark.createDataFrame(ends, _schema(images, by, "rounds int, settled boolean, sigma double"))
    return _result(last, images, plan, ended, names)
