"""Row-wise and aggregate operators over visibilities.  All are built-in expressions: one scan, and a shuffle only to group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from visloom.functions import columns as C


def unflagged(vis: DataFrame) -> DataFrame:
    return vis.where("NOT flagged")


def in_wavelengths(vis: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds u, v, w in wavelengths of the row's channel; the channel table is one row a channel of the instrument, and is broadcast.

    Shuffled by channel, all rows would meet in as many tasks as there are channels.
    """
    rows = vis.join(F.broadcast(channels), "ch")
    return rows.withColumns({a: C.wavelengths(F.col(f"{a}_m"), F.col("freq_hz")) for a in "uvw"})


def normalised(vis: DataFrame, half: float) -> DataFrame:
    """u, v scaled to [-pi, pi] with v and w negated."""
    return vis.withColumns({"u": F.col("u_m") * math.pi / half, "v": -F.col("v_m") * math.pi / half, "w": -F.col("w_m")})


def half_plane(vis: DataFrame) -> DataFrame:
    """u and v folded to v >= 0 by Hermitian symmetry."""
    return vis.withColumns({"u": F.when(F.col("v") < 0, -F.col("u")).otherwise(F.col("u")), "v": F.abs("v")})


def on_grid(vis: DataFrame, size: int) -> DataFrame:
    return vis.withColumns({"q": C.cell(F.col("u"), size), "p": C.cell(F.col("v"), size)})


def baseline_lengths(vis: DataFrame) -> DataFrame:
    """Mean projected length of each antenna pair, flagged rows included."""
    return vis.groupBy("ant1", "ant2").agg(F.avg(F.sqrt(F.col("u_m") ** 2 + F.col("v_m") ** 2)).alias("length"))


def averaging_factors(vis: DataFrame, max_t: int, max_f: int, spacing_hz: float | None = None, theta: float | None = None, smearing: float = 1.0) -> DataFrame:
    """Baseline-dependent averaging factors n_t, n_f per pair: longest length over own length, cut to 1..max.

    With channel spacing and field angle, n_f is cut at the smearing limit as well.  A zero length takes the maxima.
    """
    lengths = baseline_lengths(vis)
    ratio = F.floor(F.col("longest") / F.when(F.col("length") > 0, F.col("length")))
    top = lengths.agg(F.max("length").alias("longest"))
    rows = lengths.crossJoin(F.broadcast(top))  # one row
    cut = lambda m: F.coalesce(C.clipped(ratio, F.lit(1), F.lit(m)), F.lit(m)).cast("int")
    rows = rows.withColumns({"n_t": cut(max_t), "n_f": cut(max_f)})
    if spacing_hz and theta and max_f > 1:
        limit = F.floor(F.lit(smearing * C.LIGHT / spacing_hz / theta) / F.when(F.col("length") > 0, F.col("length")))
        rows = rows.withColumn("n_f", F.least("n_f", F.greatest(F.coalesce(limit, F.lit(max_f)), F.lit(1))).cast("int"))
    return rows.select("ant1", "ant2", "length", "n_t", "n_f")


def averaged(vis: DataFrame, factors: DataFrame, channels: DataFrame, snapshots: int, n_channels: int) -> DataFrame:
    """Averaging bins of unflagged rows: unweighted mean coordinates, sums, weighted mean visibility, natural weight.

    Rows are summed by pair, snapshot and channel first, in each task before they are shuffled, and the sums meet the factors of their
    pair: a task has sums where the join would have it sort the rows of a few pairs.
    """
    w = F.col("nw") * F.col("nw")
    parts = {"u": F.col("u"), "v": F.col("v"), "re": F.col("re"), "im": F.col("im"), "w_re": w * F.col("re"), "w_im": w * F.col("im"), "w": w}
    sums = [F.count(F.lit(1)).alias("n"), F.count("u").alias("n_u"), F.count("v").alias("n_v"), *[F.sum(c).alias(f"s_{k}") for k, c in parts.items()]]
    rows = in_wavelengths(unflagged(vis), channels).groupBy("ant1", "ant2", "t", "ch").agg(*sums)
    rows = rows.join(factors.select("ant1", "ant2", "n_t", "n_f"), ["ant1", "ant2"])
    rows = rows.withColumns({"t_bin": F.floor(F.col("t") / F.col("n_t")).cast("int"), "f_bin": F.floor(F.col("ch") / F.col("n_f")).cast("int")})
    total = lambda k: F.sum(f"s_{k}")
    return (
        rows.groupBy("ant1", "ant2", "f_bin", "t_bin", "n_t", "n_f")
        .agg(
            F.sum("n").alias("n"), F.try_divide(total("u"), F.sum("n_u")).alias("u"), F.try_divide(total("v"), F.sum("n_v")).alias("v"), total("re").alias("sum_re"), total("im").alias("sum_im"),
            (total("w_re") / total("w")).alias("re"), (total("w_im") / total("w")).alias("im"), F.sqrt(total("w")).alias("nw"),
        )
        .withColumns({
            "t_start": F.col("t_bin") * F.col("n_t"), "t_end": F.least((F.col("t_bin") + 1) * F.col("n_t"), F.lit(snapshots)),
            "f_start": F.col("f_bin") * F.col("n_f"), "f_end": F.least((F.col("f_bin") + 1) * F.col("n_f"), F.lit(n_channels)),
        })
    )


def uniform_weights(gridded: DataFrame) -> DataFrame:
    """Adds nwimag = 1 / sqrt(rows of the cell): cells are counted with map-side partial sums and joined back."""
    cells = gridded.groupBy("p", "q").agg(F.count(F.lit(1)).alias("density"))
    return gridded.join(cells, ["p", "q"]).withColumn("nwimag", 1 / F.sqrt("density"))


def briggs_weights(gridded: DataFrame, robustness: float) -> DataFrame:
    """Adds nwimag by Briggs's robust rule over the cells' sums of squared natural weights."""
    cells = gridded.groupBy("p", "q").agg(F.sum(F.col("nw") * F.col("nw")).alias("g"))
    scale = cells.agg((F.sum("g") / F.sum(F.col("g") * F.col("g")) * (5 * 10.0**-robustness) ** 2).alias("s"))
    return gridded.join(cells.crossJoin(F.broadcast(scale)), ["p", "q"]).withColumn("nwimag", 1 / F.sqrt(1 + F.col("s") * F.col("g")))


def nearest_stack(vis: DataFrame, stacks: int) -> DataFrame:
    """Adds the index of the nearest of evenly spaced w centres, as plain arithmetic on the range of w."""
    span = vis.agg(F.min("w_m").alias("w_lo"), F.max("w_m").alias("w_hi"))
    rows = vis.crossJoin(F.broadcast(span))  # one row
    step = (F.col("w_hi") - F.col("w_lo")) / stacks
    at = F.when(step > 0, C.clipped(F.floor((F.col("w_m") - F.col("w_lo")) / step), F.lit(0), F.lit(stacks - 1))).otherwise(0).cast("int")
    return rows.withColumn("stack", at).withColumn("w0", F.col("w_lo") + (F.col("stack") + 0.5) * step).drop("w_lo", "w_hi")


def choose_denoiser(ratios: DataFrame, shelf: DataFrame) -> DataFrame:
    """For each ratio the shelf entry of the largest sigma not above it (else the smallest), and the next sigma.

    The shelf is a configuration table; its intervals are made by one window and matched by range.
    """
    w = W.orderBy("sigma")
    spans = shelf.select("sigma", F.lead("sigma").over(w).alias("next_sigma"), F.row_number().over(w).alias("rank"))
    low = F.when(F.col("rank") == 1, F.lit(float("-inf"))).otherwise(F.col("sigma"))
    spans = spans.withColumns({"lo": low, "hi": F.coalesce("next_sigma", F.lit(float("inf")))})
    return ratios.join(F.broadcast(spans), (F.col("ratio") >= F.col("lo")) & (F.col("ratio") < F.col("hi"))).drop("lo", "hi", "rank")


def rank_one_projections(vis: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """Per snapshot and projection: sum of conj(a[ant1]) y a[ant2] with unit-modulus antenna phases from a portable hash."""
    angle = lambda a: (((F.col(a) * 7919 + F.col("k") * 104729 + seed * 31) % 1009) / 1009.0) * (2 * math.pi)
    rows = vis.select("t", "ch", "ant1", "ant2", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    re, im = C.turned(F.col("re"), F.col("im"), angle("ant2") - angle("ant1"))
    return rows.groupBy("t", "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def modulated(projections: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """Sums over snapshots of the projections under signs +1 and -1 from a portable hash: k, m, re, im."""
    sign = F.when((F.col("t") * 6151 + F.col("m") * 12289 + seed) % 769 % 2 == 0, 1.0).otherwise(-1.0)
    rows = projections.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("m"))
    return rows.groupBy("k", "m").agg(F.sum(sign * F.col("re")).alias("re"), F.sum(sign * F.col("im")).alias("im"))


def haar_level(images: DataFrame) -> DataFrame:
    """One level of the orthonormal 2-D Haar analysis of long images: vec_id, band, y, x, v."""
    even = lambda a: F.when(F.col(a) % 2 == 0, 1.0).otherwise(-1.0)
    bands = [("ll", F.lit(1.0)), ("lh", even("x")), ("hl", even("y")), ("hh", even("x") * even("y"))]
    sums = images.groupBy("vec_id", F.floor(F.col("y") / 2).cast("int").alias("by"), F.floor(F.col("x") / 2).cast("int").alias("bx")).agg(*[(F.sum(F.col("v") * s) / 2).alias(b) for b, s in bands])
    return sums.selectExpr("vec_id", "by as y", "bx as x", "stack(4, 'll', ll, 'lh', lh, 'hl', hl, 'hh', hh) as (band, v)")


def periodic_filter(signals: DataFrame, taps: list[float], size: int) -> DataFrame:
    """Periodised correlation of 1-D signals (vec_id, i, v) with a short tap list at stride 2: vec_id, k, v."""
    tap = F.array(*[F.lit(t) for t in taps])
    rows = signals.select("vec_id", "i", "v", F.posexplode(tap).alias("j", "tap"))
    at = F.pmod(F.col("i") - F.col("j"), F.lit(size))
    return rows.where(at % 2 == 0).groupBy("vec_id", (at / 2).cast("int").alias("k")).agg(F.sum(F.col("v") * F.col("tap")).alias("v"))


def stacks_needed(vis: DataFrame, field: float) -> DataFrame:
    """Per channel the w stacks that a field of view (radians) asks for: ch, stacks, far (largest |w|, wavelengths)."""
    far = F.max(F.abs("w"))
    bend = 1 - math.sqrt(1 - 2 * math.sin(field / 2) ** 2)
    return vis.groupBy("ch").agg(F.ceil(far * 2 * math.pi * bend).cast("int").alias("stacks"), far.alias("far"))


def projected_on_ball(vis: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """re, im moved onto the l2 ball around (re0, im0) of each group; radius scale * sqrt(m + 2 sqrt(m)).  Adds shrink.

    Groups are reduced to one row each before they meet the rows again, so a hot group costs a partial sum a task.
    """
    m = F.count(F.lit(1))
    gap = F.sqrt(F.sum(F.col("nw") ** 2 * ((F.col("re") - F.col("re0")) ** 2 + (F.col("im") - F.col("im0")) ** 2)))
    radius = scale * F.sqrt(m + 2 * F.sqrt(m))
    norms = vis.groupBy(*keys).agg(F.when(gap > 0, F.least(F.lit(1.0), radius / gap)).otherwise(1.0).alias("shrink"))
    moved = {a: F.col(f"{a}0") + (F.col(a) - F.col(f"{a}0")) * F.col("shrink") for a in ("re", "im")}
    return vis.join(norms, keys).withColumns(moved)


def sampled(vis: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Rows whose key hash falls under the fraction: the same rows on every engine and partitioning, without a sort."""
    ring = 1000003
    key = F.col("ant1").cast("long") * 7919 + F.col("ant2").cast("long") * 104729 + F.col("t").cast("long") * 1299709 + F.col("ch").cast("long") * 15485863 + F.round("w_m").cast("long") * 32452843 + seed
    return vis.where(F.pmod(key, F.lit(ring)) < fraction * ring)


def stacks_of_least_cost(vis: DataFrame, stacks: int, bins: int = 2048) -> tuple[DataFrame, list[float]]:
    """Adds stack and w0 of the nearest centre of w_m, and returns the sorted centres: clusters of least summed squared distance.

    All rows are counted into ``bins`` equal bins of the range of w (a row each, with sums of w and its square), and a dynamic
    programme over the bins finds the best of all ways to part them, so there are no restarts and no sample.  Clusters end at edges of bins.
    Every row is then labelled by the midpoints between centres, without a join.  Fewer filled bins give fewer stacks; a null w has no stack.
    """
    w = F.col("w_m").cast("double")
    low, high = vis.agg(F.min(w), F.max(w)).first()
    if low is None:
        return vis.withColumns({"stack": F.lit(None).cast("int"), "w0": F.lit(None).cast("double")}), []
    at = F.floor((w - low) * (bins / ((high - low) or 1.0))) if high > low else F.lit(0)
    part = vis.where(w.isNotNull()).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w - low).alias("s"), F.sum((w - low) ** 2).alias("q"))
    found = part.orderBy("bin").toPandas()  # one row a bin
    n, s, q = (np.concatenate([[0.0], np.cumsum(found[c].to_numpy(float))]) for c in ("n", "s", "q"))
    m = len(found)
    i, j = np.arange(m + 1)[:, None], np.arange(m + 1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        cost = np.where(i < j, (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i]), np.inf)  # of bins i to j - 1 as one cluster
    best, ways = cost[0].copy(), []
    for _ in range(min(stacks, m) - 1):
        total = best[:, None] + cost
        ways.append(total.argmin(axis=0))
        best = total.min(axis=0)
    edges = [m]
    for way in reversed(ways):
        edges.append(int(way[edges[-1]]))
    edges = [0, *sorted(edges)]
    centres = [low + float((s[b] - s[a]) / (n[b] - n[a])) for a, b in zip(edges, edges[1:])]
    middles = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    stack = sum(((w > x).cast("int") for x in middles), F.when(w.isNotNull(), F.lit(0)))
    return vis.withColumn("stack", stack).withColumn("w0", F.element_at(F.array(*[F.lit(c) for c in centres]), F.col("stack") + 1)), centres


def projected_on_ellipse(vis: DataFrame, keys: list[str], scale: float = 1.0, most: int = 10, least: int = 1, tolerance: float = 1e-6) -> DataFrame:
    """re, im moved to the ellipse around (re0, im0) under the weights ``precond``; radius as for the ball.

    At most ``most`` projected-gradient steps of size 1 / max(precond)^2, from (re_prev, im_prev) where the columns exist, else from the
    centre.  A step multiplies the distances from the centre by numbers that depend on the row's weight alone, so the rows are
    reduced once to three sums a weight and group; the steps run on those, and their two factors are joined back.  A group's sums, one
    row for each distinct weight (at most the cells that the weights were gridded on), meet in one task.
    """
    warm = "re_prev" in vis.columns
    part = lambda a: F.col(a) - F.col(f"{a[:2]}0")
    prev = {a: part(f"{a}_prev") if warm else F.lit(0.0) for a in ("re", "im")}
    sums = vis.groupBy(*keys, "precond").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("xx"), F.sum(part("re") ** 2 + part("im") ** 2).alias("ee"),
        F.sum(prev["re"] ** 2 + prev["im"] ** 2).alias("pp"), F.sum(part("re") * prev["re"] + part("im") * prev["im"]).alias("ep"),
    )
    types = dict(sums.dtypes)

    def factors_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, ee, pp, ep = (pdf[c].to_numpy(float) for c in ("precond", "ee", "pp", "ep"))
        rows = pdf["m"].sum()
        radius, size = scale * math.sqrt(rows + 2 * math.sqrt(rows)), math.sqrt(pdf["xx"].sum())
        g = w / (np.abs(w).max() ** 2 or 1.0)
        norm = lambda a, c: math.sqrt(max(0.0, float((a * a * pp + 2 * a * c * ep + c * c * ee).sum())))
        a, c = np.ones(len(w)), np.zeros(len(w))
        for i in range(most):
            away = norm(-a, 1 - c)
            a, c = a * (1 - g), c * (1 - g) + g
            length = norm(a, c)
            shrink = min(1.0, radius / length) if length else 1.0
            a, c = shrink * a, shrink * c
            if i > least and away < tolerance * size:
                break
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "precond": pdf["precond"], "_a": a, "_c": c})

    schema = ", ".join([f"`{k}` {types[k]}" for k in [*keys, "precond"]] + ["_a double", "_c double"])
    factors = sums.groupBy(*keys).applyInPandas(factors_of, schema)
    moved = {a: F.col(f"{a}0") + F.col("_a") * prev[a] + F.col("_c") * part(a) for a in ("re", "im")}
    return vis.join(factors, [*keys, "precond"]).withColumns(moved).drop("_a", "_c")


def projection_sizes(pixels: int, antennas: int, snapshots: int, channels: int, ratio: float = 1.0, same: bool = True) -> tuple[float, int, int, int]:
    """Share eps of each dimension that gives ratio * pixels measurements: (eps, projections, snapshot and channel modulations).

    With one random vector for both antennas of a pair, p (p - 1) / 2 projections of p = eps * antennas count, so eps solves
    eps^4 - eps^3 / antennas = 2 ratio pixels / (antennas^2 snapshots channels); with two vectors p^2 count.
    """
    if min(pixels, antennas, snapshots, channels) < 1 or ratio <= 0:
        raise ValueError("sizes and ratio are positive")
    target = ratio * pixels / (antennas**2 * snapshots * channels)
    low, high = 0.0, 1.0
    value = (lambda e: e**4 - e**3 / antennas - 2 * target) if same else (lambda e: e**4 - target)
    while value(high) < 0:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high, *(max(1, math.ceil(high * n - 1e-9)) for n in (antennas, snapshots, channels))
