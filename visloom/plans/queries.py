"""Registered queries over the visibility operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from visloom.functions import columns as C
from visloom.operators import fourier, gridding, projections as P, tiled, visibility as V, wavelets
from visloom.plans import imager, solvers, sparse_lines
from visloom.sources import channels as H, tables as T
from visloom.storage import shared_dir, written
from visloom.streaming.batches import process_files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
HALF, GRID, SNAPSHOTS = 800.0, 64, 64
TIE = 3.7e-9  # moves exact halves off the rounding edge, where two orders of a sum could part
PI = repr(math.pi)
VALUES = ", ".join(f"({c}, {f!r}::double)" for c, f in T.CHANNELS)
PRE = f"WITH vis AS ({T.VIS_SELECT.format(source='lineitem')}), channels(ch, freq_hz) AS (VALUES {VALUES})"
WL = f"lam AS (SELECT v.*, freq_hz, u_m*freq_hz/{T.LIGHT!r} AS u, v_m*freq_hz/{T.LIGHT!r} AS v, w_m*freq_hz/{T.LIGHT!r} AS w FROM vis v JOIN channels USING (ch))"
NORM = f"nrm AS (SELECT *, u_m*{PI}/{HALF} AS u, -v_m*{PI}/{HALF} AS v FROM vis WHERE NOT flagged)"
CELL = f"((CAST(floor((AXIS+{PI})*{GRID}/2/{PI}) AS INT) - 1) % {GRID} + {GRID}) % {GRID}"
GRIDDED = f"{NORM}, fold AS (SELECT ant1, ant2, t, ch, re, im, nw, CASE WHEN v < 0 THEN -u ELSE u END AS u, abs(v) AS v FROM nrm), grd AS (SELECT *, {CELL.replace('AXIS', 'u')} AS q, {CELL.replace('AXIS', 'v')} AS p FROM fold)"
FACT = f"len AS (SELECT ant1, ant2, avg(sqrt(u_m*u_m + v_m*v_m)) AS length FROM vis GROUP BY 1, 2), fac AS (SELECT ant1, ant2, length, CAST(greatest(1, least(8, floor((SELECT max(length) FROM len)/length))) AS INT) AS n_t, CAST(greatest(1, least(4, floor((SELECT max(length) FROM len)/length))) AS INT) AS n_f0 FROM len), f2 AS (SELECT ant1, ant2, length, n_t, CAST(least(n_f0, greatest(1, floor({T.LIGHT / 8e6 / 0.05!r}/length))) AS INT) AS n_f FROM fac)"


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals: the order of a distributed sum is not fixed."""
    return df.select(*[(F.round(F.col(c) + TIE, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _query(oracle: str | None = None, rounds: str = "", keys: str = "", name: str | None = None):
    """Registers a query; the oracle's ``rounds`` columns are rounded as the query's doubles are."""

    def add(f):
        n = name or f.__name__
        _QUERIES[n] = lambda spark, d: _rounded(f(spark, d))
        if oracle:
            cols = [k for k in keys.replace(",", " ").split()] + [f"round({r} + {TIE!r}, 6) + 0.0 AS {r}" for r in rounds.replace(",", " ").split()]
            _ORACLES[n] = f"SELECT {', '.join(cols)} FROM ({oracle}) AS o"
        return f

    return add


def _gridded(spark: SparkSession, d: str) -> DataFrame:
    return V.on_grid(V.half_plane(V.normalised(V.unflagged(T.visibilities(spark, d)), HALF)), GRID)


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = V.normalised(V.unflagged(T.visibilities(spark, d)), HALF)
    return rows.withColumn("weight", F.col("nw") * F.col("nw"))


@_query(f"{PRE} SELECT ch, count(*) AS n, count(DISTINCT t) AS snapshots, count(DISTINCT ant1*100+ant2) AS baselines, sqrt(sum(re*re+im*im)) AS norm, stddev_pop(re) AS sd_pop, stddev_samp(re) AS sd_samp, max(sqrt(u_m*u_m+v_m*v_m)) AS longest FROM vis WHERE NOT flagged GROUP BY ch", "norm sd_pop sd_samp longest", "ch n snapshots baselines")
def vis_unflagged_stats(spark, d):
    kept = V.unflagged(T.visibilities(spark, d))
    return kept.groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("snapshots"), F.countDistinct(F.col("ant1") * 100 + F.col("ant2")).alias("baselines"), F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("norm"), F.stddev_pop("re").alias("sd_pop"), F.stddev_samp("re").alias("sd_samp"), F.max(F.sqrt(F.col("u_m") ** 2 + F.col("v_m") ** 2)).alias("longest"))


@_query(f"{PRE}, {WL} SELECT ch, freq_hz, max(sqrt(u*u+v*v)) AS longest, 180/{PI}*3600/(2*max(sqrt(u*u+v*v))) AS pixel_arcsec, avg(w) AS mean_w FROM lam WHERE NOT flagged GROUP BY 1, 2", "freq_hz longest pixel_arcsec mean_w", "ch")
def vis_wavelengths(spark, d):
    rows = V.in_wavelengths(V.unflagged(T.visibilities(spark, d)), T.channels(spark))
    far = F.max(F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))
    return rows.groupBy("ch", "freq_hz").agg(far.alias("longest"), (180 / math.pi * 3600 / (2 * far)).alias("pixel_arcsec"), F.avg("w").alias("mean_w"))


@_query(f"{PRE}, {GRIDDED} SELECT p, q, count(*) AS n, sum(nw*nw) AS weight FROM grd GROUP BY 1, 2", "weight", "p q n")
def vis_grid(spark, d):
    return _gridded(spark, d).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nw") ** 2).alias("weight"))


@_query(f"{PRE}, {GRIDDED}, c AS (SELECT p, q, count(*) AS n FROM grd GROUP BY 1, 2) SELECT ant1, ant2, count(*) AS n, sum(1/sqrt(c.n)) AS sum_w, max(1/sqrt(c.n)) AS max_w FROM grd JOIN c USING (p, q) GROUP BY 1, 2", "sum_w max_w", "ant1 ant2 n")
def weights_uniform(spark, d):
    return V.uniform_weights(_gridded(spark, d)).groupBy("ant1", "ant2").agg(F.count(F.lit(1)).alias("n"), F.sum("nwimag").alias("sum_w"), F.max("nwimag").alias("max_w"))


@_query(f"{PRE}, {GRIDDED}, c AS (SELECT p, q, sum(nw*nw) AS g FROM grd GROUP BY 1, 2), s AS (SELECT sum(g)/sum(g*g)*25 AS s FROM c) SELECT ant1, ant2, sum(1/sqrt(1+s*g)) AS sum_w, sum(nw/sqrt(1+s*g)*re) AS sum_re FROM grd JOIN c USING (p, q) CROSS JOIN s GROUP BY 1, 2", "sum_w sum_re", "ant1 ant2")
def weights_briggs(spark, d):
    rows = V.briggs_weights(_gridded(spark, d), 0.0)
    return rows.groupBy("ant1", "ant2").agg(F.sum("nwimag").alias("sum_w"), F.sum(F.col("nw") * F.col("nwimag") * F.col("re")).alias("sum_re"))


@_query(f"{PRE}, {FACT} SELECT * FROM f2", "length", "ant1 ant2 n_t n_f")
def bda_factors(spark, d):
    return V.averaging_factors(T.visibilities(spark, d), 8, 4, 8e6, 0.05)


_BDA = f"{PRE}, {WL}, {FACT}, b AS (SELECT ant1, ant2, CAST(floor(ch/n_f) AS INT) AS f_bin, CAST(floor(t/n_t) AS INT) AS t_bin, n_t, n_f, count(*) AS n, avg(u) AS u, avg(v) AS v, sum(re) AS sum_re, sum(im) AS sum_im, sum(nw*nw*re)/sum(nw*nw) AS re, sum(nw*nw*im)/sum(nw*nw) AS im, sqrt(sum(nw*nw)) AS nw FROM lam JOIN f2 USING (ant1, ant2) WHERE NOT flagged GROUP BY 1,2,3,4,5,6)"


def _bda(spark: SparkSession, d: str) -> DataFrame:
    vis = T.visibilities(spark, d)
    return V.averaged(vis, V.averaging_factors(vis, 8, 4, 8e6, 0.05), T.channels(spark), SNAPSHOTS, len(T.CHANNELS))


@_query(f"{_BDA} SELECT *, t_bin*n_t AS t_start, least((t_bin+1)*n_t, 64) AS t_end, f_bin*n_f AS f_start, least((f_bin+1)*n_f, 4) AS f_end FROM b", "u v sum_re sum_im re im nw", "ant1 ant2 f_bin t_bin n_t n_f n t_start t_end f_start f_end")
def bda(spark, d):
    return _bda(spark, d)


@_query(f"{_BDA} SELECT count(*) AS n_out, CAST(sum(n) AS BIGINT) AS n_in, sum(n)/count(*) AS ratio, min(n) AS least, max(n) AS most FROM b", "ratio", "n_out n_in least most")
def bda_statistics(spark, d):
    return _bda(spark, d).agg(F.count(F.lit(1)).alias("n_out"), F.sum("n").alias("n_in"), (F.sum("n") / F.count(F.lit(1))).alias("ratio"), F.min("n").alias("least"), F.max("n").alias("most"))


@_query(f"{PRE}, {NORM} SELECT t, sum((re-1.7)*cos(2*{PI}*(u*0.1+v*0.2)) - im*sin(2*{PI}*(u*0.1+v*0.2))) AS re, sum((re-1.7)*sin(2*{PI}*(u*0.1+v*0.2)) + im*cos(2*{PI}*(u*0.1+v*0.2))) AS im FROM nrm GROUP BY t", "re im", "t")
def vis_subtract_and_shift(spark, d):
    rows = V.normalised(V.unflagged(T.visibilities(spark, d)), HALF)
    re, im = C.turned(F.col("re") - 1.7, F.col("im"), 2 * math.pi * (F.col("u") * 0.1 + F.col("v") * 0.2))
    return rows.groupBy("t").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


@_query(f"{PRE}, s AS (SELECT min(w_m) AS lo, (max(w_m)-min(w_m))/8 AS st FROM vis) SELECT CAST(greatest(0, least(7, floor((w_m-lo)/st))) AS INT) AS stack, count(*) AS n, avg(abs(w_m-(lo+(greatest(0, least(7, floor((w_m-lo)/st)))+0.5)*st))) AS mean_gap FROM vis CROSS JOIN s GROUP BY 1", "mean_gap", "stack n")
def w_stacks(spark, d):
    return V.nearest_stack(T.visibilities(spark, d), 8).groupBy("stack").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("w_m") - F.col("w0"))).alias("mean_gap"))


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    """Noise level over the brightest amplitude of each snapshot and channel."""
    peak = F.max(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    return T.visibilities(spark, d).groupBy("t", "ch").agg((F.lit(3e-5) / peak).alias("ratio"))


_SH = ", ".join(f"({s!r}::double)" for s in T.SHELF)


@_query(f"{PRE}, shelf(sigma) AS (VALUES {_SH}), r AS (SELECT t, ch, 3e-5/max(sqrt(re*re + im*im)) AS ratio FROM vis GROUP BY t, ch) SELECT t, ch, round(ratio*1e9) AS ratio_e9, round(coalesce((SELECT max(sigma) FROM shelf WHERE sigma <= ratio), (SELECT min(sigma) FROM shelf))*1e9) AS sigma_e9, round((SELECT min(sigma) FROM shelf WHERE sigma > coalesce((SELECT max(sigma) FROM shelf WHERE sigma <= ratio), (SELECT min(sigma) FROM shelf)))*1e9) AS next_e9 FROM r", "ratio_e9 sigma_e9 next_e9", "t ch")
def denoiser_choice(spark, d):
    found = V.choose_denoiser(_ratios(spark, d), T.shelf(spark))
    return found.select("t", "ch", *[F.round(F.col(c) * 1e9).alias(n) for c, n in (("ratio", "ratio_e9"), ("sigma", "sigma_e9"), ("next_sigma", "next_e9"))])


@_query(f"{PRE}, {NORM}, a AS (SELECT unnest(range(-4, 4)) AS i) SELECT CAST(y.i AS INT) AS y, CAST(x.i AS INT) AS x, sum(nw*nw*(re*cos(u*x.i+v*y.i) - im*sin(u*x.i+v*y.i))) AS dirty, sum(nw*nw*cos(u*x.i+v*y.i)) AS psf FROM nrm, a y, a x GROUP BY 1, 2", "dirty psf", "y x")
def dirty_and_psf(spark, d):
    return fourier.dirty_image(_weighted(spark, d), 8)


_ANG = "(((%s*7919 + k*104729 + 31) % 1009)/1009.0)*2*" + PI
_PH = f"({_ANG.replace('%s', 'ant2')} - {_ANG.replace('%s', 'ant1')})"
_ROP = f"rop AS (SELECT t, k, sum(re*cos({_PH}) - im*sin({_PH})) AS re, sum(re*sin({_PH}) + im*cos({_PH})) AS im FROM vis, (SELECT unnest(range(0, 6)) AS k) WHERE NOT flagged GROUP BY 1, 2)"


@_query(f"{PRE}, {_ROP} SELECT t, CAST(k AS INT) AS k, re, im FROM rop", "re im", "t k")
def rank_one_projection(spark, d):
    return V.rank_one_projections(V.unflagged(T.visibilities(spark, d)), 6)


@_query(f"{PRE}, {_ROP} SELECT CAST(k AS INT) AS k, CAST(m AS INT) AS m, sum(CASE WHEN (t*6151+m*12289+1) % 769 % 2 = 0 THEN 1.0 ELSE -1.0 END*re) AS re, sum(CASE WHEN (t*6151+m*12289+1) % 769 % 2 = 0 THEN 1.0 ELSE -1.0 END*im) AS im FROM rop, (SELECT unnest(range(0, 5)) AS m) GROUP BY 1, 2", "re im", "k m")
def modulated_projection(spark, d):
    return V.modulated(V.rank_one_projections(V.unflagged(T.visibilities(spark, d)), 6), 5)


_IMG = "img AS (SELECT vec_id, CAST(floor(i/8) AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(embedding[i+1] AS DOUBLE) AS v, i FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"


@_query(f"WITH {_IMG}, b AS (SELECT unnest(['ll','lh','hl','hh']) AS band) SELECT vec_id, band, y//2 AS y, x//2 AS x, sum(v*CASE band WHEN 'll' THEN 1 WHEN 'lh' THEN 1-2*(x%2) WHEN 'hl' THEN 1-2*(y%2) ELSE (1-2*(x%2))*(1-2*(y%2)) END)/2 AS v FROM img, b GROUP BY 1,2,3,4", "v", "vec_id band y x")
def haar_analysis(spark, d):
    return V.haar_level(T.images(spark, d))


DB2 = [(1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2))]
_TAPS = ", ".join(f"({j}, {t!r}::double)" for j, t in enumerate(DB2))


@_query(f"WITH {_IMG}, taps(j, tap) AS (VALUES {_TAPS}) SELECT vec_id, CAST((i-j+64) % 64 // 2 AS INT) AS k, sum(v*tap) AS v FROM img, taps WHERE (i-j+64) % 64 % 2 = 0 GROUP BY 1, 2", "v", "vec_id k")
def db2_periodic_analysis(spark, d):
    signal = T.images(spark, d).select("vec_id", (F.col("y") * 8 + F.col("x")).alias("i"), "v")
    return V.periodic_filter(signal, DB2, 64)


@_query(f"WITH {_IMG} SELECT vec_id, sum(sign(v)*greatest(abs(v)-0.05, 0)) AS soft, sum(greatest(-0.05, least(0.05, v))) AS dual, sum(0.01/(0.01+abs(v))) AS reweight, sum(greatest(v, 0)) AS positive, sum(abs(v)*0.01/(0.01+abs(v))) AS weighted_l1 FROM img GROUP BY 1", "soft dual reweight positive weighted_l1", "vec_id")
def proximity_steps(spark, d):
    v = F.col("v")
    return T.images(spark, d).groupBy("vec_id").agg(F.sum(C.soft(v, 0.05)).alias("soft"), F.sum(C.soft_dual(v, 0.05)).alias("dual"), F.sum(C.reweighted(v, 0.01)).alias("reweight"), F.sum(F.greatest(v, F.lit(0.0))).alias("positive"), F.sum(F.abs(v) * C.reweighted(v, 0.01)).alias("weighted_l1"))


@_query(f"WITH {_IMG}, p AS (SELECT a.vec_id, a.v AS g, b.v AS m FROM img a JOIN img b ON b.vec_id = a.vec_id + 1 AND b.i = a.i) SELECT vec_id, 20*log10(sqrt(sum(g*g))/sqrt(sum((g-m)*(g-m)))) AS snr, sqrt(sum((g-m)*(g-m)))/(sqrt(sum(g*g))+1e-10) AS variation, sqrt(sum(g*g)) AS norm FROM p GROUP BY 1 HAVING sum((g-m)*(g-m)) > 0", "snr variation norm", "vec_id")
def image_metrics(spark, d):
    a = T.images(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("m"))
    gap, own = F.sum((F.col("v") - F.col("m")) ** 2), F.sqrt(F.sum(F.col("v") ** 2))
    return a.join(b, ["vec_id", "y", "x"]).groupBy("vec_id").agg((20 * F.log10(own / F.sqrt(gap))).alias("snr"), (F.sqrt(gap) / (own + 1e-10)).alias("variation"), own.alias("norm"), gap.alias("gap")).where("gap > 0").drop("gap")


@_query(f"WITH {_IMG}, m AS (SELECT vec_id, max(abs(v)) AS top FROM img GROUP BY 1) SELECT vec_id, sum(top*log10(1000*abs(v)/top + 1)/log10(1000)) AS total FROM img JOIN m USING (vec_id) WHERE top > 0 GROUP BY 1", "total", "vec_id")
def log_map(spark, d):
    rows = T.images(spark, d).withColumn("a", F.abs("v"))
    top = rows.groupBy("vec_id").agg(F.max("a").alias("top")).where("top > 0")
    return rows.join(top, "vec_id").groupBy("vec_id").agg(F.sum(C.logged(F.col("a"), 1000.0, F.col("top"))).alias("total"))


@_query(f"{PRE} SELECT ch, count(*) AS m, sqrt(count(*) + 2*sqrt(count(*))) AS bound FROM vis WHERE NOT flagged GROUP BY ch", "bound", "ch m")
def data_fidelity_bound(spark, d):
    m = F.count(F.lit(1))
    return V.unflagged(T.visibilities(spark, d)).groupBy("ch").agg(m.alias("m"), F.sqrt(m + 2 * F.sqrt(m)).alias("bound"))


@_query(f"{PRE}, o AS (SELECT t, count(*) AS n FROM vis GROUP BY t) SELECT t, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS row_index, n, n - lag(n) OVER (ORDER BY t) AS step FROM o", "", "t row_index n step")
def snapshot_index(spark, d):
    rows = T.visibilities(spark, d).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("t")  # one row a snapshot of the instrument
    return rows.select("t", (F.dense_rank().over(w) - 1).cast("int").alias("row_index"), "n", (F.col("n") - F.lag("n").over(w)).alias("step"))


@_query(f"{PRE} SELECT DISTINCT ant1, ant2, CAST(ant1*32 - ant1*(ant1+1)/2 + (ant2-ant1-1) AS INT) AS bl FROM vis", "", "ant1 ant2 bl")
def baseline_index(spark, d):
    return T.visibilities(spark, d).selectExpr("ant1", "ant2", f"{T.antenna_pair_index(32)} as bl").distinct()


@_query(f"{PRE}, g AS (SELECT t, ant1, ant2, round(avg(u_m), 3) AS u_m FROM vis GROUP BY 1, 2, 3), f AS (SELECT g.t, g.ant1, g.ant2, c.ch, g.u_m*freq_hz/{T.LIGHT!r} AS u FROM g CROSS JOIN channels c), o AS (SELECT t, ant1, ant2, ch, min(flagged) AS flagged FROM vis GROUP BY 1,2,3,4) SELECT ch, count(*) AS n, count(*) FILTER (WHERE coalesce(flagged, true)) AS n_flagged, sum(abs(u)) AS sum_u FROM f LEFT JOIN o USING (t, ant1, ant2, ch) GROUP BY ch", "sum_u", "ch n n_flagged")
def geometry_fill(spark, d):
    vis = T.visibilities(spark, d)
    geom = vis.groupBy("t", "ant1", "ant2").agg(F.round(F.avg("u_m"), 3).alias("u_m"))
    full = geom.crossJoin(F.broadcast(T.channels(spark))).withColumn("u", C.wavelengths(F.col("u_m"), F.col("freq_hz")))
    seen = vis.groupBy("t", "ant1", "ant2", "ch").agg(F.min("flagged").alias("flagged"))
    rows = full.join(seen, ["t", "ant1", "ant2", "ch"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(True)))
    return rows.groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.sum(F.abs("u")).alias("sum_u"))


@_query(f"{PRE}, k AS (SELECT DISTINCT t, ch FROM vis), done AS (SELECT DISTINCT t, ch FROM vis WHERE re > 10.4) SELECT t, ch FROM k ANTI JOIN done USING (t, ch)", "", "t ch")
def batches_to_do(spark, d):
    vis = T.visibilities(spark, d)
    return vis.select("t", "ch").distinct().join(vis.where("re > 10.4").select("t", "ch").distinct(), ["t", "ch"], "left_anti")


@_query(f"{PRE} SELECT t, sum((nw*re + (2-nw)*im)/2) AS stokes_i, count(*) AS n FROM vis WHERE NOT (flagged OR (re = 0 AND im = 0) OR nw > 1.4) GROUP BY t", "stokes_i", "t n")
def stokes_and_flags(spark, d):
    bad = F.col("flagged") | ((F.col("re") == 0) & (F.col("im") == 0)) | (F.col("nw") > 1.4)
    w1, w4 = F.col("nw"), 2 - F.col("nw")
    return T.visibilities(spark, d).where(~bad).groupBy("t").agg(F.sum((w1 * F.col("re") + w4 * F.col("im")) / (w1 + w4)).alias("stokes_i"), F.count(F.lit(1)).alias("n"))


@_query()
def reconstruction(spark, d):
    """Forward-backward loop, an image a channel; held to its own objective in tests."""
    return imager.reconstruct(_weighted(spark, d), imager.Settings(side=64), keys=["ch"])


_IN = "axis AS (SELECT unnest(range(-4, 4)) AS i)"
MODEL = [[((3 * y + 5 * x) % 7) / 7 for x in range(8)] for y in range(8)]
_MODEL = ", ".join(f"({y - 4}, {x - 4}, {v!r}::double)" for y, row in enumerate(MODEL) for x, v in enumerate(row))


@_query(f"{PRE}, {NORM}, pix(y, x, a) AS (VALUES {_MODEL}), m AS (SELECT u, v, any_value(0) AS z, sum(a*cos(u*x+v*y)) AS re, -sum(a*sin(u*x+v*y)) AS im FROM (SELECT DISTINCT u, v FROM nrm) AS k, pix GROUP BY u, v) SELECT n.t, n.ch, sum(m.re) AS re_model, sum(m.im) AS im_model, sum((n.re-m.re)*(n.re-m.re) + (n.im-m.im)*(n.im-m.im)) AS misfit FROM nrm n JOIN m ON n.u = m.u AND n.v = m.v GROUP BY 1, 2", "re_model im_model misfit", "t ch")
def forward_model(spark, d):
    rows = fourier.predicted(_weighted(spark, d).select("t", "ch", "u", "v", "re", "im"), np.array(MODEL))
    gap = (F.col("re") - F.col("re_model")) ** 2 + (F.col("im") - F.col("im_model")) ** 2
    return rows.groupBy("t", "ch").agg(F.sum("re_model").alias("re_model"), F.sum("im_model").alias("im_model"), F.sum(gap).alias("misfit"))


PIXEL = 0.02
_STACKED = f"s AS (SELECT min(w_m) AS lo, (max(w_m)-min(w_m))/8 AS st FROM vis WHERE NOT flagged), z AS (SELECT u, v, re, im, nw*nw AS weight, lo + (greatest(0, least(7, floor((w_m-lo)/st)))+0.5)*st AS w0 FROM nrm CROSS JOIN s)"


@_query(f"{PRE}, {NORM}, {_STACKED}, {_IN} SELECT CAST(y.i AS INT) AS y, CAST(x.i AS INT) AS x, sum(weight*(re*cos(u*x.i+v*y.i + 2*{PI}*w0*(sqrt(1-({PIXEL}*x.i)*({PIXEL}*x.i)-({PIXEL}*y.i)*({PIXEL}*y.i))-1)) - im*sin(u*x.i+v*y.i + 2*{PI}*w0*(sqrt(1-({PIXEL}*x.i)*({PIXEL}*x.i)-({PIXEL}*y.i)*({PIXEL}*y.i))-1)))/sqrt(1-({PIXEL}*x.i)*({PIXEL}*x.i)-({PIXEL}*y.i)*({PIXEL}*y.i))) AS dirty FROM z, axis y, axis x GROUP BY 1, 2", "dirty", "y x")
def dirty_w_stacked(spark, d):
    return fourier.stacked_image(V.nearest_stack(_weighted(spark, d), 8), 8, PIXEL)


@_query(f"{PRE}, {WL} SELECT ch, CAST(ceil(max(abs(w))*2*{PI}*(1-sqrt(1-2*sin(0.25)*sin(0.25)))) AS INT) AS stacks, max(abs(w)) AS far FROM lam WHERE NOT flagged GROUP BY ch", "far", "ch stacks")
def w_stack_count(spark, d):
    return V.stacks_needed(V.in_wavelengths(V.unflagged(T.visibilities(spark, d)), T.channels(spark)), 0.5)


@_query(f"{PRE}, c AS (SELECT ch, freq_hz, count(*) AS n FROM vis JOIN channels USING (ch) WHERE NOT flagged GROUP BY 1, 2) SELECT ch, n, freq_hz/1e6 - lag(freq_hz/1e6) OVER (ORDER BY ch) AS step_mhz, CASE WHEN count(*) OVER () > 1 THEN (max(freq_hz) OVER () - min(freq_hz) OVER ())/(count(*) OVER () - 1)/1e6 ELSE freq_hz/1e6 END AS mean_mhz FROM c", "step_mhz mean_mhz", "ch n")
def channel_spacing(spark, d):
    used = V.unflagged(T.visibilities(spark, d)).groupBy("ch").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(T.channels(spark)), "ch")
    w, every = W.orderBy("ch"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row a channel
    mhz = F.col("freq_hz") / 1e6
    count = F.count(F.lit(1)).over(every)
    mean = F.when(count > 1, (F.max(mhz).over(every) - F.min(mhz).over(every)) / (count - 1)).otherwise(mhz)
    return used.select("ch", "n", (mhz - F.lag(mhz).over(w)).alias("step_mhz"), mean.alias("mean_mhz"))


@_query(f"{PRE}, {NORM}, n AS (SELECT ch, sqrt(sum(nw*nw*((re-3)*(re-3)+(im-0)*(im-0)))) AS far, 0.5*sqrt(count(*) + 2*sqrt(count(*))) AS radius FROM nrm GROUP BY ch) SELECT ch, t, sum(3 + (re-3)*least(1, radius/far)) AS re, sum(im*least(1, radius/far)) AS im, max(least(1, radius/far)) AS shrink FROM nrm JOIN n USING (ch) GROUP BY 1, 2", "re im shrink", "ch t")
def ball_projection(spark, d):
    rows = V.normalised(V.unflagged(T.visibilities(spark, d)), HALF).withColumns({"re0": F.lit(3.0), "im0": F.lit(0.0)})
    return V.projected_on_ball(rows, ["ch"], 0.5).groupBy("ch", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.max("shrink").alias("shrink"))


_MIX = "((ant1*{a} + ant2*{b} + t*7919 + ch*31 + 104729) % 10007 + 0.5e0)/10007e0"
_NOISE = f"noise AS (SELECT u, v, nw, re AS dre, im AS dim, sqrt(-ln({_MIX.format(a=613, b=1297)}))*cos(2*{PI}*{_MIX.format(a=3571, b=8191)}) AS re, sqrt(-ln({_MIX.format(a=613, b=1297)}))*sin(2*{PI}*{_MIX.format(a=3571, b=8191)}) AS im FROM nrm)"


@_query(f"{PRE}, {NORM}, {_NOISE}, {_IN}, img AS (SELECT y.i, x.i, sum(nw*(re*cos(u*x.i+v*y.i) - im*sin(u*x.i+v*y.i))) AS d, sum(nw*nw*cos(u*x.i+v*y.i)) AS psf, sum(nw*nw*(dre*cos(u*x.i+v*y.i) - dim*sin(u*x.i+v*y.i))) AS dirty FROM noise, axis y, axis x GROUP BY 1, 2) SELECT stddev_samp(d) AS spread, max(psf) AS peak, max(dirty) AS brightest, stddev_samp(d)/max(psf)/max(dirty) AS level FROM img", "spread peak brightest level")
def noise_heuristic(spark, d):
    return fourier.noise_level(V.normalised(V.unflagged(T.visibilities(spark, d)), HALF), 8)


@_query(f"{PRE} SELECT ch, t, ant1, ant2, w_m, count(*) AS n FROM vis WHERE ((ant1*7919 + ant2*104729 + t*1299709 + ch*15485863 + CAST(round(w_m) AS BIGINT)*32452843 + 42) % 1000003 + 1000003) % 1000003 < 10000.03 GROUP BY 1,2,3,4,5", "w_m", "ch t ant1 ant2 n")
def sampled_rows(spark, d):
    return V.sampled(T.visibilities(spark, d), 0.01, 42).groupBy("ch", "t", "ant1", "ant2", "w_m").agg(F.count(F.lit(1)).alias("n"))


_LO, _HI = wavelets.daubechies(2), wavelets.high_pass(wavelets.daubechies(2))
_PAIRS = ", ".join(f"({j}, {a!r}::double, {b!r}::double)" for j, (a, b) in enumerate(zip(_LO, _HI)))


@_query(f"WITH {_IMG}, taps(j, lo, hi) AS (VALUES {_PAIRS}), xs AS (SELECT vec_id, y, CAST((x-j+8) % 8 // 2 AS INT) AS x, sum(v*lo) AS l, sum(v*hi) AS h FROM img, taps WHERE (x-j+8) % 2 = 0 GROUP BY 1,2,3), ys AS (SELECT vec_id, x, CAST((y-j+8) % 8 // 2 AS INT) AS y, sum(l*lo) AS ll, sum(h*lo) AS lh, sum(l*hi) AS hl, sum(h*hi) AS hh FROM xs, taps WHERE (y-j+8) % 2 = 0 GROUP BY 1,2,3) SELECT vec_id, CAST(2 AS INT) AS basis, CAST(1 AS INT) AS level, b.band, y, x, CASE b.band WHEN 'll' THEN ll WHEN 'lh' THEN lh WHEN 'hl' THEN hl ELSE hh END AS v FROM ys, (SELECT unnest(['ll','lh','hl','hh']) AS band) b", "v", "vec_id basis level band y x")
def db2_image_analysis(spark, d):
    return wavelets.analysis(T.images(spark, d), [2], 8, 1)


_ALL_TAPS = ", ".join(f"({o}, {j}, {lo!r}::double, {hi!r}::double, {2 * o})" for o in range(1, 9) for low in [wavelets.daubechies(o)] for j, (lo, hi) in enumerate(zip(low, wavelets.high_pass(low))))


def _levels_sql(levels: int, mode: str) -> str:
    """CTEs of the coefficients of eight bases and the Dirac one, level after level: vec_id, basis, level, band, y, x, v."""
    parts = [f"taps(basis, j, lo, hi, len) AS (VALUES {_ALL_TAPS})", "s0 AS (SELECT vec_id, CAST(o AS INT) AS basis, y, x, v FROM img, (SELECT unnest(range(1, 9)) AS o))"]
    found = ["SELECT vec_id, 0 AS basis, 0 AS level, 'dirac' AS band, y, x, v FROM img"]
    for k in range(1, levels + 1):
        n = 8 >> (k - 1)
        at = {a: f"((({a}-j) % {n}) + {n}) % {n}" if mode == "periodic" else f"({a}+len-2-j)" for a in "xy"}
        parts.append(f"r{k} AS (SELECT vec_id, basis, y, CAST({at['x']} // 2 AS INT) AS x, sum(v*lo) AS l, sum(v*hi) AS h FROM s{k - 1} JOIN taps USING (basis) WHERE {at['x']} % 2 = 0 GROUP BY 1,2,3,4)")
        parts.append(f"q{k} AS (SELECT vec_id, basis, x, CAST({at['y']} // 2 AS INT) AS y, sum(l*lo) AS ll, sum(h*lo) AS lh, sum(l*hi) AS hl, sum(h*hi) AS hh FROM r{k} JOIN taps USING (basis) WHERE {at['y']} % 2 = 0 GROUP BY 1,2,3,4)")
        parts.append(f"s{k} AS (SELECT vec_id, basis, y, x, ll AS v FROM q{k})")
        found += [f"SELECT vec_id, basis, {k}, '{b}', y, x, {b} FROM q{k}" for b in ("lh", "hl", "hh") + (("ll",) if k == levels else ())]
    return ", ".join(parts) + f", words AS ({' UNION ALL '.join(found)})"


def _digest(images: DataFrame, levels: int, mode: str) -> DataFrame:
    """Energy and a moment that tells every coefficient's place, by image, basis, level and band."""
    return wavelets.band_sums(images, 8, levels, list(range(1, 9)), mode, lambda y, x: 1 + 0.37 * y + 0.11 * x)


_DIGEST = "SELECT vec_id, basis, level, band, count(*) AS n, sum(v*v)/9 AS energy, sum(v*(1 + 0.37e0*y + 0.11e0*x))/3 AS moment FROM words GROUP BY 1, 2, 3, 4"


@_query(f"WITH {_IMG}, {_levels_sql(3, 'periodic')} {_DIGEST}", "energy moment", "vec_id basis level band n")
def dictionary_energy(spark, d):
    """Periodised coefficients of db1 to db8 and the Dirac basis."""
    return _digest(T.images(spark, d), 3, "periodic")


@_query(f"WITH {_IMG}, {_levels_sql(4, 'zero')} {_DIGEST}", "energy moment", "vec_id basis level band n")
def dictionary_zero_mode(spark, d):
    """The same with zeros outside the image, four levels."""
    return _digest(T.images(spark, d), 4, "zero")


@_query()
def wavelet_thresholded(spark, d):
    """Soft threshold of all zero-mode coefficients and synthesis summed over bases; compared with plain loops in tests."""
    return wavelets.thresholded(T.images(spark, d), 8, 4, list(range(1, 9)), 0.02, "zero")


@_query(f"WITH {_IMG} SELECT vec_id, CAST(o AS INT) AS basis, y, x, v FROM img, (SELECT unnest([2, 5]) AS o)", "v", "vec_id basis y x")
def wavelet_round_trip(spark, d):
    return wavelets.resynthesised(T.images(spark, d), [2, 5], 8)


_PAD = "img AS (SELECT vec_id, i, CAST(embedding[i+1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), places AS (SELECT unnest(range(-3, 68)) AS a), src AS (SELECT a, 'zero' AS mode, a AS s FROM places UNION ALL SELECT a, 'constant', greatest(0, least(63, a)) FROM places UNION ALL SELECT a, 'periodic', (a+64) % 64 FROM places UNION ALL SELECT a, 'symmetric', CASE WHEN a < 0 THEN -1-a WHEN a > 63 THEN 127-a ELSE a END FROM places UNION ALL SELECT a, 'reflect', CASE WHEN a < 0 THEN -a WHEN a > 63 THEN 126-a ELSE a END FROM places)"


@_query(f"WITH {_PAD} SELECT vec_id, mode, count(*) AS n, sum(v*(a+4)) AS moment FROM (SELECT vec_id, mode, a, coalesce(v, 0) AS v FROM (SELECT DISTINCT vec_id FROM img) k CROSS JOIN src LEFT JOIN img USING (vec_id) WHERE img.i = src.s UNION ALL SELECT vec_id, 'zero', a, 0 FROM (SELECT DISTINCT vec_id FROM img), places WHERE a < 0 OR a > 63) GROUP BY 1, 2", "moment", "vec_id mode n")
def padding_modes(spark, d):
    signal = T.images(spark, d).select("vec_id", (F.col("y") * 8 + F.col("x")).alias("i"), "v")
    parts = [wavelets.padded(signal, 64, 3, 4, m).withColumn("mode", F.lit(m)) for m in ("zero", "constant", "periodic", "symmetric", "reflect")]
    return reduce(DataFrame.unionByName, parts).groupBy("vec_id", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * (F.col("i") + 4)).alias("moment"))


@_query(f"WITH {_IMG}, f AS (SELECT vec_id, vec_id % 4 AS t, y, CASE WHEN vec_id // 4 % 2 = 1 THEN 7-x ELSE x END AS x, v FROM img) SELECT vec_id, CAST(CASE t WHEN 0 THEN y WHEN 1 THEN 7-x WHEN 2 THEN 7-y ELSE x END AS INT) AS y, CAST(CASE t WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7-x ELSE 7-y END AS INT) AS x, v FROM f", "v", "vec_id y x")
def image_orientation(spark, d):
    rows = T.images(spark, d).withColumns({"turns": F.col("vec_id") % 4, "flip": F.floor(F.col("vec_id") / 4) % 2 == 1})
    return wavelets.oriented(rows, 8).select("vec_id", "y", "x", "v")


@_query(f"{PRE}, shelf(sigma) AS (VALUES {_SH}), r AS (SELECT t, ch, 3e-5/max(sqrt(re*re + im*im)) AS ratio FROM vis GROUP BY t, ch), c AS (SELECT t, ch, (SELECT max(sigma) FROM shelf WHERE sigma <= ratio) AS lo, (SELECT min(sigma) FROM shelf WHERE sigma > ratio) AS hi FROM r) SELECT t, ch, coalesce(3e-5/hi, 0) AS peak_min, 3e-5/lo AS peak_max FROM c", "peak_min peak_max", "t ch")
def denoiser_peak_range(spark, d):
    """Peaks for which a choice of denoiser stands; a null peak_max has no upper bound."""
    under = F.col("ratio") < F.col("sigma")  # below the whole shelf
    low = F.when(under, 3e-5 / F.col("sigma")).otherwise(F.coalesce(3e-5 / F.col("next_sigma"), F.lit(0.0)))
    return V.choose_denoiser(_ratios(spark, d), T.shelf(spark)).select("t", "ch", low.alias("peak_min"), F.when(~under, 3e-5 / F.col("sigma")).alias("peak_max"))


@_query()
def reconstruction_reweighted(spark, d):
    """Reweighted sparse loop, an image a channel; held to its residual in tests."""
    return solvers.reweighted_sparse(_weighted(spark, d), 16, keys=["ch"])


@_query()
def reconstruction_constrained(spark, d):
    """Primal-dual loop held to each channel's residual bound; compared with a dual value per visibility in tests."""
    return solvers.constrained(_weighted(spark, d), 8, None, lambda x: np.maximum(x, 0), keys=["ch"])


_GEOM, _ROWS = H.GEOMETRY.format(source="orders"), H.CHANNEL_ROWS.format(source="lineitem")
_FIRST, _COUNT = 2, 4
_JOINED = f"WITH geom AS ({_GEOM}), chan AS ({_ROWS}), lam AS (SELECT c.ch, g.t, g.ant1, g.ant2, re, im, coalesce(nw, 1) AS nw, u_m*(1e9 + c.ch*8e6)/{T.LIGHT!r} AS u, v_m*(1e9 + c.ch*8e6)/{T.LIGHT!r} AS v, w_m*(1e9 + c.ch*8e6)/{T.LIGHT!r} AS w FROM chan c JOIN geom g USING (row) WHERE NOT flagged AND c.ch BETWEEN {_FIRST} AND {_FIRST + _COUNT - 1})"


def _channels_joined(spark: SparkSession, d: str) -> DataFrame:
    """Four channels from the third on, with the geometry of the main file."""
    rows = H.channel_range(H.channel_rows(spark, d), _FIRST, _COUNT)
    return H.with_geometry(rows, H.geometry(spark, d), H.frequencies(spark, 1e9, 8e6, 7))


@_query(f"{_JOINED} SELECT ch, t, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(w) AS w, sum(nw*re) AS re, sum(nw*im) AS im FROM lam GROUP BY 1, 2", "u v w re im", "ch t n")
def channel_files(spark, d):
    sums = [F.sum(a).alias(a) for a in "uvw"] + [F.sum(F.col("nw") * F.col(a)).alias(a) for a in ("re", "im")]
    return _channels_joined(spark, d).groupBy("ch", "t").agg(F.count(F.lit(1)).alias("n"), *sums)


@_query(f"{_JOINED} SELECT max(sqrt(u*u+v*v)) AS longest, 180/{PI}*3600/(2*max(sqrt(u*u+v*v))) AS pixel_arcsec FROM lam", "longest pixel_arcsec")
def channel_pixel(spark, d):
    return H.longest_baseline(_channels_joined(spark, d))


_HZ = 1.008e9
_D = "CASE WHEN l_quantity = 7 THEN 0e0 ELSE round({}, 6) END"
_EXTRACT = f"r AS (SELECT l_orderkey AS row, (l_suppkey % 27 - 13) * 30e0 + l_quantity AS u_m, (l_partkey % 41 - 20) * 25e0 AS v_m, (l_orderkey % 101 - 50) * 3e0 AS w_m, l_discount*10 + 2 AS w1, l_discount*10 + 5 AS w4, {_D.format('l_extendedprice/10000 + 1')} AS r1, {_D.format('l_extendedprice/10000 + 4')} AS r4, {_D.format('l_tax*10')} AS i1, {_D.format('l_tax*10 - 3')} AS i4 FROM lineitem WHERE l_suppkey % 3 = 1 AND l_returnflag <> 'R' AND (l_partkey + 1) % 11 <> 0 AND (l_partkey + 7) % 11 <> 0)"


@_query(f"WITH {_EXTRACT} SELECT row, u_m*{_HZ!r}/{T.LIGHT!r} AS u, v_m*{_HZ!r}/{T.LIGHT!r} AS v, w_m*{_HZ!r}/{T.LIGHT!r} AS w, (w1*r1 + w4*r4)/(w1 + w4) AS re, (w1*i1 + w4*i4)/(w1 + w4) AS im, sqrt(w1 + w4) AS nw FROM r WHERE NOT ((w1*r1 + w4*r4) = 0 AND (w1*i1 + w4*i4) = 0)", "u v w re im nw", "row")
def main_table_extraction(spark, d):
    return H.extracted(H.main_table(spark, d), 1, 1, _HZ)


_STEPS = 10
_ELLIPSE = f"{PRE}, {NORM}, e0 AS (SELECT ch, t, nw, re - 3 AS er, im AS ei, 0e0 AS dr, 0e0 AS di, nw/max(nw) OVER (PARTITION BY ch)/max(nw) OVER (PARTITION BY ch) AS g, 0.5*sqrt(count(*) OVER (PARTITION BY ch) + 2*sqrt(count(*) OVER (PARTITION BY ch))) AS radius FROM nrm)"
for _i in range(_STEPS):
    _ELLIPSE += f", m{_i} AS (SELECT * REPLACE (dr - g*(dr - er) AS dr, di - g*(di - ei) AS di) FROM e{_i}), e{_i + 1} AS (SELECT m.* REPLACE (dr*least(1, radius/far) AS dr, di*least(1, radius/far) AS di) FROM m{_i} m JOIN (SELECT ch, sqrt(sum(dr*dr + di*di)) AS far FROM m{_i} GROUP BY ch) USING (ch))"


@_query(f"{_ELLIPSE} SELECT ch, t, sum(3 + dr) AS re, sum(di) AS im, count(*) AS n FROM e{_STEPS} GROUP BY 1, 2", "re im", "ch t n")
def ellipse_projection(spark, d):
    rows = V.normalised(V.unflagged(T.visibilities(spark, d)), HALF).withColumns({"re0": F.lit(3.0), "im0": F.lit(0.0), "precond": F.col("nw")})
    return V.projected_on_ellipse(rows, ["ch"], 0.5, _STEPS).groupBy("ch", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count(F.lit(1)).alias("n"))


@_query()
def w_stacks_kmeans(spark, d):
    """Centres of w of least cost over all rows; every row is labelled; held to the best of 30 restarts in tests."""
    rows, _ = V.stacks_of_least_cost(T.visibilities(spark, d), 8)
    return rows.groupBy("stack", "w0").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("w_m") - F.col("w0"))).alias("mean_gap"))


SIDE = 8
_CELLS, _REACH = gridding.OVER * SIDE, gridding.WIDTH / 2
_BELL = f"(CASE WHEN abs(z) <= 1 THEN exp({gridding.BETA!r}*(sqrt(greatest(0, 1 - z*z)) - 1)) ELSE 0 END)"
_KERNEL = lambda a, c: _BELL.replace("z", f"(({a} - {c})*{1 / _REACH!r})")
_SPREAD = f"tap AS (SELECT unnest(range(0, {gridding.WIDTH})) AS j), pos AS (SELECT n.*, v*{_CELLS / (2 * math.pi)!r} AS pv, u*{_CELLS / (2 * math.pi)!r} AS pu FROM nrm n), near AS (SELECT p.*, ceil(pv - {_REACH}) + y.j AS cy, ceil(pu - {_REACH}) + x.j AS cx FROM pos p, tap y, tap x), put AS (SELECT *, ((CAST(cy AS INT) % {_CELLS}) + {_CELLS}) % {_CELLS} AS gy, ((CAST(cx AS INT) % {_CELLS}) + {_CELLS}) % {_CELLS} AS gx, {_KERNEL('pv', 'cy')}*{_KERNEL('pu', 'cx')} AS k FROM near)"
_SUMMED = f"cells AS (SELECT ch, gy, gx, sum(k*nw*nw*re) AS re, sum(k*nw*nw*im) AS im, sum(k*nw*nw) AS weight, sum(k*nw*nw*nw*nw) AS square FROM put GROUP BY 1, 2, 3)"
_BACK = ", ".join(f"({i - SIDE // 2}, {float(t)!r}::double)" for i, t in enumerate(gridding.transform_of_bell(SIDE)))


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_SUMMED} SELECT * FROM cells", "re im weight square", "ch gy gx")
def gridded_cells(spark, d):
    return gridding.spread(_weighted(spark, d), SIDE, ["ch"])


_ANGLE = f"(2*{PI}/{_CELLS}*(gy*y.i + gx*x.i))"


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_SUMMED}, back(i, b) AS (VALUES {_BACK}) SELECT ch, y.i AS y, x.i AS x, sum(re*cos{_ANGLE} - im*sin{_ANGLE})/any_value(y.b*x.b) AS dirty, sum(weight*cos{_ANGLE})/any_value(y.b*x.b) AS psf FROM cells, back y, back x GROUP BY 1, 2, 3", "dirty psf", "ch y x")
def gridded_image(spark, d):
    return gridding.dirty_image(_weighted(spark, d), SIDE, ["ch"])


@_query(f"{PRE}, {NORM}, {_SPREAD}, back(i, b) AS (VALUES {_BACK}), pix(y, x, a) AS (VALUES {_MODEL}), axis AS (SELECT unnest(range(0, {_CELLS})) AS g), wide AS (SELECT gy.g AS gy, gx.g AS gx, sum(a/(y.b*x.b)*cos(2*{PI}/{_CELLS}*(gy.g*p.y + gx.g*p.x))) AS c, -sum(a/(y.b*x.b)*sin(2*{PI}/{_CELLS}*(gy.g*p.y + gx.g*p.x))) AS s FROM pix p JOIN back y ON y.i = p.y JOIN back x ON x.i = p.x, axis gy, axis gx GROUP BY 1, 2) SELECT t, ch, sum(k*c) AS re_model, sum(k*s) AS im_model FROM put JOIN wide USING (gy, gx) GROUP BY 1, 2", "re_model im_model", "t ch")
def gridded_forward(spark, d):
    rows = gridding.predicted(_weighted(spark, d).select("t", "ch", "u", "v"), np.array(MODEL))
    return rows.groupBy("t", "ch").agg(F.sum("re_model").alias("re_model"), F.sum("im_model").alias("im_model"))

_SPEC = P.Projection(count=4, snapshots=SNAPSHOTS, channels=4, snapshot_signs=3, channel_signs=2)
_SAME = P.Projection(count=5, snapshots=SNAPSHOTS, channels=4, seed=7, same=True, vary="channel", kind="gaussian")
_ALL = P.Projection(count=4, snapshots=SNAPSHOTS, channels=4, snapshot_signs=3, channel_signs=2, seed=3, same=True, vary="all")


def _numbers(n: int, name: str) -> str:
    return f"(SELECT CAST(unnest(range(0, {n})) AS INT) AS {name}) AS n_{name}"


def _projected_sql(spec: P.Projection, rows: str, tag: str, weight: str = "nw*nw") -> str:
    """CTEs of the weighted terms c of a table of rows, their projections d and the modulation z of these."""
    c = repr(spec.correction)
    return (
        f"c{tag} AS (SELECT t, ch, p, {weight}*{c}*re AS re, {weight}*{c}*im AS im, {spec.phase()} AS a, {spec.size()} AS s FROM {rows}, {_numbers(spec.count, 'p')}), "
        f"d{tag} AS (SELECT t, ch, p, sum(s*(re*cos(a) - im*sin(a))) AS re, sum(s*(re*sin(a) + im*cos(a))) AS im FROM c{tag} GROUP BY 1, 2, 3), "
        f"z{tag} AS (SELECT p, mb, mk, sum({spec.sign('mb', 't', 0)}*{spec.sign('mk', 'ch', 1)}*re) AS re, sum({spec.sign('mb', 't', 0)}*{spec.sign('mk', 'ch', 1)}*im) AS im FROM d{tag}, {_numbers(spec.snapshot_signs, 'mb')}, {_numbers(spec.channel_signs, 'mk')} GROUP BY 1, 2, 3)"
    )


def _back_sql(spec: P.Projection, tag: str) -> str:
    """CTEs of what the modulated values z give back to each row: f with id, t, ch, u, v, nw, re, im."""
    signs = f"{spec.sign('mb', 't', 0)}*{spec.sign('mk', 'ch', 1)}"
    return (
        f"e{tag} AS (SELECT t, ch, p, sum({signs}*re) AS zr, sum({signs}*im) AS zi FROM z{tag}, {_numbers(spec.snapshots, 't')}, {_numbers(spec.channels, 'ch')} GROUP BY 1, 2, 3), "
        f"g{tag} AS (SELECT id, t, ch, u, v, nw, zr, zi, {spec.phase()} AS a, {spec.size()} AS s FROM (SELECT *, row_number() OVER () AS id FROM nrm) JOIN e{tag} USING (t, ch)), "
        f"f{tag} AS (SELECT id, t, ch, any_value(u) AS u, any_value(v) AS v, any_value(nw) AS nw, sum(s*(zr*cos(a) + zi*sin(a))) AS re, sum(s*(zi*cos(a) - zr*sin(a))) AS im FROM g{tag} GROUP BY 1, 2, 3)"
    )


@_query(f"{PRE}, {NORM}, {_projected_sql(_SPEC, 'nrm', '')} SELECT * FROM z", "re im", "p mb mk")
def projected_data(spark, d):
    """Projections of the weighted rows with two vectors for the antennas of a pair, modulated over snapshots and channels."""
    return P.measured(_weighted(spark, d), _SPEC)


@_query(f"{PRE}, {NORM}, {_projected_sql(_SAME, 'nrm', '', '1e0')} SELECT t, ch, p, re/{_SAME.correction!r} AS re, im/{_SAME.correction!r} AS im FROM d", "re im", "t ch p")
def projected_same(spark, d):
    """Projections by one Gaussian vector a channel for both antennas."""
    return P.projected(_weighted(spark, d), _SAME)


@_query(f"{PRE}, {NORM}, {_projected_sql(_SPEC, 'nrm', '')}, {_back_sql(_SPEC, '')} SELECT t, ch, count(*) AS n, sum(re)/1e3 AS re, sum(im)/1e3 AS im, avg(sqrt(re*re + im*im))/1e3 AS size FROM f GROUP BY 1, 2", "re im size", "t ch n")
def projected_back(spark, d):
    """The adjoint of projection and modulation at every row."""
    rows = _weighted(spark, d)
    back = P.gridless(rows, P.measured(rows, _SPEC), _SPEC)
    size = F.avg(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)) / 1e3
    return back.groupBy("t", "ch").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(c) / 1e3).alias(c) for c in ("re", "im")], size.alias("size"))


_PROJECTED = ", ".join(f"m{t} AS (SELECT y.i AS y, x.i AS x, sum(nw*nw*{_SPEC.correction!r}*(re*cos(u*x.i+v*y.i) - im*sin(u*x.i+v*y.i))) AS v FROM f{t}, axis y, axis x GROUP BY 1, 2)" for t in "ab")


@_query(f"{PRE}, {NORM}, {_IN}, one AS (SELECT * REPLACE (1e0 AS re, 0e0 AS im) FROM nrm), {_projected_sql(_SPEC, 'nrm', 'a')}, {_back_sql(_SPEC, 'a')}, {_projected_sql(_SPEC, 'one', 'b')}, {_back_sql(_SPEC, 'b')}, {_PROJECTED} SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, ma.v/(SELECT max(v) FROM mb) AS dirty, mb.v/(SELECT max(v) FROM mb) AS psf FROM ma JOIN mb USING (y, x)", "dirty psf", "y x")
def projected_dirty(spark, d):
    """Image and point spread of projected data, over the peak of the latter."""
    image = written(P.dirty_image(_weighted(spark, d), 8, _SPEC), "projected-image")
    peak = image.agg(F.max("psf").alias("peak"))  # one row
    return image.crossJoin(F.broadcast(peak)).select("y", "x", *[(F.col(c) / F.col("peak")).alias(c) for c in ("dirty", "psf")])


def _energies(spark: SparkSession, d: str, form: str, spec: P.Projection) -> DataFrame:
    power = F.sum(F.col("re") ** 2 + F.col("im") ** 2)
    rows = _weighted(spark, d)
    w = F.col("weight")
    before = rows.agg(F.sum(w * w * (F.col("re") ** 2 + F.col("im") ** 2)).alias("energy"))  # one row
    after = P.measured(rows, spec).agg(F.count(F.lit(1)).alias("n_values"), power.alias("projected"))  # one row
    return before.crossJoin(after).select(F.lit(form).alias("form"), F.lit(spec.correction).alias("correction"), "n_values", (F.col("projected") / F.col("energy")).alias("ratio"))


_FORMS = {"two_vectors": _SPEC, "same_for_all": _ALL}


@_query(f"{PRE}, {NORM}, " + ", ".join(_projected_sql(s, "nrm", f"_{f}") for f, s in _FORMS.items()) + ", w AS (SELECT sum(nw*nw*nw*nw*(re*re+im*im)) AS energy FROM nrm) " + " UNION ALL ".join(f"SELECT '{f}' AS form, {s.correction!r}::double AS correction, count(*) AS n_values, sum(re*re+im*im)/any_value(energy) AS ratio FROM z_{f}, w" for f, s in _FORMS.items()), "correction ratio", "form n_values")
def weighting_correction(spark, d):
    """Factor of the weights for both forms, and the projected energy under it over that of the rows."""
    return reduce(DataFrame.unionByName, [_energies(spark, d, form, spec) for form, spec in _FORMS.items()])


_FILES = "SELECT CASE o_orderkey % 4 WHEN 0 THEN concat('run/obs_id_', o_custkey % 50, '_ch.mat') WHEN 1 THEN concat('run/obs_', o_custkey % 50, '.mat') WHEN 2 THEN 'run/obs_id_x_ch.mat' ELSE concat('run/obs_id_', o_custkey % 50) END AS path FROM {source}"


@_query(f"WITH f AS ({_FILES.format(source='orders')}), s AS (SELECT path, coalesce(try_cast(regexp_extract(path, '_id_([^_]*)', 1) AS INT), 1) AS seed, count(*) AS n FROM f GROUP BY 1, 2) SELECT path, seed, n, {P.draw('seed', 3, 1)} AS first FROM s", "", "path seed n first")
def projection_seeds(spark, d):
    """Seed of each file from its name, and a number drawn under it."""
    files = spark.sql(_FILES.format(source="{orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    seeds = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", P.seed_of(F.col("path")))
    return seeds.withColumn("first", F.expr(P.draw("seed", 3, 1)))

_TILED = "cells AS (SELECT ch, gy, gx, sum(k*nw*nw*re) AS re, sum(k*nw*nw*im) AS im, sum(k*nw*nw) AS weight FROM put GROUP BY 1, 2, 3)"


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_TILED}, back(i, b) AS (VALUES {_BACK}) SELECT ch, y.i AS y, x.i AS x, sum(re*cos{_ANGLE} - im*sin{_ANGLE})/any_value(y.b*x.b) AS dirty, sum(weight*cos{_ANGLE})/any_value(y.b*x.b) AS psf FROM cells, back y, back x GROUP BY 1, 2, 3", "dirty psf", "ch y x")
def tiled_image(spark, d):
    """Dirty image and point spread of each channel, with images as tables of lines."""
    return tiled.dirty_image(_weighted(spark, d), SIDE, ["ch"])


_WIDE = f"axis AS (SELECT unnest(range(0, {_CELLS})) AS g), back(i, b) AS (VALUES {_BACK}), pix(y, x, a) AS (VALUES {_MODEL})"
_TURN = f"(2*{PI}/{_CELLS}*(gy.g*p.y + gx.g*p.x))"


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_WIDE}, wide AS (SELECT gy.g AS gy, gx.g AS gx, sum(a/(y.b*x.b)*cos{_TURN}) AS c, -sum(a/(y.b*x.b)*sin{_TURN}) AS s FROM pix p JOIN back y ON y.i = p.y JOIN back x ON x.i = p.x, axis gy, axis gx GROUP BY 1, 2) SELECT t, ch, sum(k*c) AS re_model, sum(k*s) AS im_model FROM put JOIN wide USING (gy, gx) GROUP BY 1, 2", "re_model im_model", "t ch")
def tiled_forward(spark, d):
    """Model visibilities gathered from tiles of the transformed model."""
    rows = tiled.predicted(_weighted(spark, d).select("t", "ch", "ant1", "ant2", "u", "v", "re"), _model_image(spark), SIDE)
    return rows.groupBy("t", "ch").agg(F.sum("re_model").alias("re_model"), F.sum("im_model").alias("im_model"))


def _model_image(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y - 4, x - 4, float(v)) for y, row in enumerate(MODEL) for x, v in enumerate(row)], "y int, x int, v double")


_LOW = "stk AS (SELECT min(w_m) AS lo, (max(w_m)-min(w_m))/8 AS st FROM vis WHERE NOT flagged)"
_STK = "sput AS (SELECT p.*, CAST(greatest(0, least(7, floor((w_m-lo)/st))) AS INT) AS stack, lo + (greatest(0, least(7, floor((w_m-lo)/st)))+0.5)*st AS w0 FROM put p CROSS JOIN stk)"
_RISE = f"sqrt(1-({PIXEL}*x.i)*({PIXEL}*x.i)-({PIXEL}*y.i)*({PIXEL}*y.i))"
_W = f"(2*{PI}*w0*({_RISE}-1))"


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_LOW}, {_STK}, back(i, b) AS (VALUES {_BACK}), cells AS (SELECT ch, stack, w0, gy, gx, sum(k*nw*nw*re) AS re, sum(k*nw*nw*im) AS im FROM sput GROUP BY 1, 2, 3, 4, 5) SELECT ch, y.i AS y, x.i AS x, sum((re*cos({_ANGLE} + {_W}) - im*sin({_ANGLE} + {_W}))/{_RISE}/(y.b*x.b)) AS dirty FROM cells, back y, back x GROUP BY 1, 2, 3", "dirty", "ch y x")
def tiled_stacked_image(spark, d):
    """Gridded adjoint with the w term of each stack, an image a channel."""
    return tiled.stacked_image(V.nearest_stack(_weighted(spark, d), 8), SIDE, PIXEL, ["ch"])


_BENT = f"bent AS (SELECT stack, w0, p.y, p.x, a/{_RISE}/(y.b*x.b)*cos{_W} AS pr, -a/{_RISE}/(y.b*x.b)*sin{_W} AS pi FROM (SELECT DISTINCT stack, w0 FROM sput), pix p JOIN back y ON y.i = p.y JOIN back x ON x.i = p.x)"


@_query(f"{PRE}, {NORM}, {_SPREAD}, {_LOW}, {_STK}, {_WIDE}, {_BENT}, wide AS (SELECT stack, gy.g AS gy, gx.g AS gx, sum(pr*cos{_TURN} + pi*sin{_TURN}) AS c, sum(pi*cos{_TURN} - pr*sin{_TURN}) AS s FROM bent p, axis gy, axis gx GROUP BY 1, 2, 3) SELECT t, ch, sum(k*c) AS re_model, sum(k*s) AS im_model FROM sput JOIN wide USING (stack, gy, gx) GROUP BY 1, 2", "re_model im_model", "t ch")
def tiled_stacked_forward(spark, d):
    """Model visibilities with the w term of each row's stack."""
    rows = V.nearest_stack(_weighted(spark, d), 8).select("t", "ch", "ant1", "ant2", "u", "v", "re", "stack", "w0")
    found = tiled.stacked_predicted(rows, _model_image(spark), SIDE, PIXEL)
    return found.groupBy("t", "ch").agg(F.sum("re_model").alias("re_model"), F.sum("im_model").alias("im_model"))


@_query()
def operator_norms(spark, d):
    """Norms of each channel's operator with and without preconditioning weights; compared with dense eigenvalues in tests."""
    rows = V.normalised(V.unflagged(T.visibilities(spark, d)), HALF)
    uniform = V.uniform_weights(V.on_grid(V.half_plane(rows), 2 * SIDE)).withColumns({"form": F.lit("preconditioned"), "weight": (F.col("nw") * F.col("nwimag")) ** 2})
    plain = rows.withColumns({"form": F.lit("plain"), "weight": F.col("nw") ** 2})
    both = [r.select("form", "ch", "u", "v", "weight") for r in (plain, uniform)]
    return tiled.operator_norms(both[0].unionByName(both[1]), SIDE, ["form", "ch"])

@_query(f"{_JOINED} SELECT ch, t, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(w) AS w, sum(nw*re) AS re, sum(nw*im) AS im FROM lam GROUP BY 1, 2", "u v w re im", "ch t n")
def channel_mat_files(spark, d):
    """Channels and main table written as MAT files, read back and joined."""
    path = f"{shared_dir(spark)}/mat-{uuid.uuid4().hex}"
    H.write_mat_files(H.channel_rows(spark, d), H.geometry(spark, d), path)
    rows, main = H.read_mat_files(spark, path)
    joined = H.with_geometry(H.channel_range(rows, _FIRST, _COUNT), main, H.frequencies(spark, 1e9, 8e6, 7))
    sums = [F.sum(a).alias(a) for a in "uvw"] + [F.sum(F.col("nw") * F.col(a)).alias(a) for a in ("re", "im")]
    return joined.groupBy("ch", "t").agg(F.count(F.lit(1)).alias("n"), *sums)


@_query(f"{_JOINED} SELECT ch, t, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(w) AS w, sum(nw*re) AS re, sum(nw*im) AS im FROM lam GROUP BY 1, 2", "u v w re im", "ch t n")
def channel_parquet_files(spark, d):
    """Channels written as one folder each; the range prunes folders."""
    path = f"{shared_dir(spark)}/channels-{uuid.uuid4().hex}"
    H.write_channel_files(H.channel_rows(spark, d), path)
    rows = H.read_channel_files(spark, path, _FIRST, _COUNT)
    joined = H.with_geometry(rows, H.geometry(spark, d), H.frequencies(spark, 1e9, 8e6, 7))
    sums = [F.sum(a).alias(a) for a in "uvw"] + [F.sum(F.col("nw") * F.col(a)).alias(a) for a in ("re", "im")]
    return joined.groupBy("ch", "t").agg(F.count(F.lit(1)).alias("n"), *sums)


_TO_GRID = T.LIGHT / 1e9 * math.pi / HALF
_BDAIMG = f"{_BDA}, {_IN}, bn AS (SELECT *, u*{_TO_GRID!r} AS x, -v*{_TO_GRID!r} AS y FROM b), fn AS (SELECT *, u*{_TO_GRID!r} AS x, -v*{_TO_GRID!r} AS y FROM lam WHERE NOT flagged)"


def _briggs_sql(rows: str, tag: str) -> str:
    fold = "(CASE WHEN y < 0 THEN -x ELSE x END)"
    return f"g{tag} AS (SELECT *, {CELL.replace('AXIS', fold)} AS q, {CELL.replace('AXIS', 'abs(y)')} AS p FROM {rows}), c{tag} AS (SELECT p, q, sum(nw*nw) AS g FROM g{tag} GROUP BY 1, 2), s{tag} AS (SELECT sum(g)/sum(g*g)*25 AS s FROM c{tag}), w{tag} AS (SELECT x, y, re, im, nw*nw/(1+s*g) AS w FROM g{tag} JOIN c{tag} USING (p, q) CROSS JOIN s{tag}), i{tag} AS (SELECT a.i AS iy, b.i AS ix, sum(w*(re*cos(x*b.i+y*a.i) - im*sin(x*b.i+y*a.i))) AS dirty, sum(w*cos(x*b.i+y*a.i)) AS psf FROM w{tag}, axis a, axis b GROUP BY 1, 2), n{tag} AS (SELECT iy, ix, dirty/max(psf) OVER () AS dirty, psf/max(psf) OVER () AS psf FROM i{tag})"


@_query(f"{_BDAIMG}, {_briggs_sql('fn', 'a')}, {_briggs_sql('bn', 'b')} SELECT (SELECT count(*) FROM fn) AS n_full, (SELECT count(*) FROM bn) AS n_averaged, sqrt(sum((a.dirty-b.dirty)*(a.dirty-b.dirty)))/sqrt(sum(a.dirty*a.dirty)) AS dirty_error, sqrt(sum((a.psf-b.psf)*(a.psf-b.psf)))/sqrt(sum(a.psf*a.psf)) AS psf_error FROM na a JOIN nb b USING (iy, ix)", "dirty_error psf_error", "n_full n_averaged")
def bda_image_error(spark, d):
    """Averaged data imaged under Briggs weights of their own, against the full data: relative error of dirty image and point spread."""
    full = V.in_wavelengths(V.unflagged(T.visibilities(spark, d)), T.channels(spark)).select("u", "v", "re", "im", "nw")
    less = _bda(spark, d).select("u", "v", "re", "im", "nw")
    images, counts = [], []
    for name, rows in (("a", full), ("b", less)):
        rows = written(rows.withColumns({"u": F.col("u") * _TO_GRID, "v": -F.col("v") * _TO_GRID}), "bda-rows")
        counts.append(rows.count())
        w = V.briggs_weights(V.on_grid(V.half_plane(rows.withColumns({"u0": F.col("u"), "v0": F.col("v")})), GRID), 0.0)
        w = w.select(F.col("u0").alias("u"), F.col("v0").alias("v"), "re", "im", ((F.col("nw") * F.col("nwimag")) ** 2).alias("weight"))
        image = written(fourier.dirty_image(w, 8), "bda-image")
        peak = image.agg(F.max("psf").alias("peak"))  # one row
        images.append(image.crossJoin(F.broadcast(peak)).select("y", "x", *[(F.col(c) / F.col("peak")).alias(f"{c}_{name}") for c in ("dirty", "psf")]))
    gap = lambda c: (F.sqrt(F.sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2)) / F.sqrt(F.sum(F.col(f"{c}_a") ** 2))).alias(f"{c}_error")
    both = images[0].join(images[1], ["y", "x"]).agg(gap("dirty"), gap("psf"))
    return both.select(F.lit(counts[0]).cast("long").alias("n_full"), F.lit(counts[1]).cast("long").alias("n_averaged"), "dirty_error", "psf_error")

_LOGGED = "log10(1000*abs(p.{c})/p.t{c} + 1)/log10(1000)"


@_query(f"WITH {_IMG}, q AS (SELECT a.vec_id, a.v AS g, b.v AS m FROM img a JOIN img b ON b.vec_id = a.vec_id + 1 AND b.i = a.i), p AS (SELECT q.*, max(abs(g)) OVER (PARTITION BY vec_id) AS tg, max(abs(m)) OVER (PARTITION BY vec_id) AS tm FROM q), l AS (SELECT vec_id, g, m, {_LOGGED.format(c='g')} AS lg, {_LOGGED.format(c='m')} AS lm FROM p WHERE tg > 0 AND tm > 0) SELECT vec_id, 20*log10(sqrt(sum(lg*lg))/sqrt(sum((lg-lm)*(lg-lm)))) AS log_snr, 0.5*sum((g-m)*(g-m)) + 0.05*sum(abs(m)*0.01/(0.01+abs(g))) AS objective FROM l GROUP BY 1 HAVING sum((lg-lm)*(lg-lm)) > 0", "log_snr objective", "vec_id")
def image_objective(spark, d):
    """SNR on the unit log scale, and half the squared misfit plus the reweighted l1 norm, of each image against the next."""
    a = T.images(spark, d).select("vec_id", "y", "x", F.col("v").alias("g"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("g").alias("m"))
    both = a.join(b, ["vec_id", "y", "x"])
    tops = both.groupBy("vec_id").agg(F.max(F.abs("g")).alias("tg"), F.max(F.abs("m")).alias("tm")).where("tg > 0 AND tm > 0")
    rows = both.join(tops, "vec_id").withColumns({f"l{c}": C.logged_unit(F.abs(c), 1000.0, F.col(f"t{c}")) for c in "gm"})
    gap, own = F.sum((F.col("lg") - F.col("lm")) ** 2), F.sqrt(F.sum(F.col("lg") ** 2))
    cost = 0.5 * F.sum((F.col("g") - F.col("m")) ** 2) + 0.05 * F.sum(F.abs("m") * C.reweighted(F.col("g"), 0.01))
    return rows.groupBy("vec_id").agg((20 * F.log10(own / F.sqrt(gap))).alias("log_snr"), cost.alias("objective"), gap.alias("gap")).where("gap > 0").drop("gap")


@_query(f"{PRE} SELECT ch, count(*) AS n, sum(nw*re) AS re, CAST(1 AS BIGINT) AS failed FROM vis GROUP BY ch", "re", "ch n failed")
def file_batches(spark, d):
    """Files of visibilities, one of them broken, each processed once by the batch driver; results put together."""
    at = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    T.visibilities(spark, d).write.parquet(f"{at}/src")
    spark.createDataFrame([("no table",)], "value string").coalesce(1).write.text(f"{at}/src/broken")
    make = lambda session, path: session.read.parquet(path).groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nw") * F.col("re")).alias("re"))
    for _ in range(2):  # the second run finds nothing to do
        process_files(spark, f"{at}/src", make, f"{at}/out", f"{at}/check", pattern="part-*")
    failed = spark.read.parquet(f"{at}/out/errors").count()
    done = spark.read.parquet(f"{at}/out/results/*").groupBy("ch").agg(F.sum("n").alias("n"), F.sum("re").alias("re"))
    return done.withColumn("failed", F.lit(failed).cast("long"))


@_query()
def reconstruction_lines(spark, d):
    """Sparse model of each channel by rounds over lines and facets, two inner solutions of a few rounds; compared with dense rounds in tests."""
    return sparse_lines.sparse(_weighted(spark, d), 64, ["ch"], solvers.Rounds(inner=8, least=4, outer=2))


def _smoother(pull: float) -> Callable[[np.ndarray, float], np.ndarray]:
    """Mean over 3 x 3 pixels with zeros outside, shrunk by ``pull`` times the noise level."""

    def smooth(pixels: np.ndarray, sigma: float) -> np.ndarray:
        wide, (h, w) = np.pad(pixels, 1), pixels.shape
        mean = sum(wide[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9
        return np.maximum(mean - pull * sigma, 0)

    return smooth


@_query()
def reconstruction_denoised_lines(spark, d):
    """Rounds with a denoiser of one pixel's reach on facets, its level chosen from a shelf for each channel; compared with whole images in tests."""
    shelf = [10.0**-i for i in range(1, 6)]
    return sparse_lines.denoised(_weighted(spark, d), 64, shelf, _smoother(0.1), 1, ["ch"], solvers.Rounds(inner=6, least=4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
