"""Random projections against dense sums, the adjoint identity, and the random numbers themselves."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.operators import projections as P

SPEC = P.Projection(count=3, snapshots=4, channels=2, snapshot_signs=3, channel_signs=2, seed=5)
FORMS = [SPEC, replace(SPEC, same=True), replace(SPEC, vary="channel", kind="gaussian"), replace(SPEC, vary="all", same=True, kind="gaussian")]
KIND = "t int, ch int, ant1 int, ant2 int, u double, v double, re double, im double, weight double, seed long"


def rows_of(n=150, seed=0):
    rng = np.random.default_rng(seed)
    ints = [rng.integers(0, k, n) for k in (4, 2)]
    a = rng.integers(0, 6, n)
    return list(zip(*[x.tolist() for x in (*ints, a, a + 1 + rng.integers(0, 3, n), *rng.uniform(-3, 3, (2, n)), *rng.normal(size=(2, n)), rng.uniform(0.5, 2, n), np.full(n, 5))]))


def number(*parts):
    h = sum(p * f for p, f in zip(parts, P.FACTORS)) % P.MODULUS
    for c in P.STEPS:
        h = h * (h + c) % P.MODULUS
    return h


def matrix(spec, rows):
    """The weighted forward map as a dense matrix: (p, mb, mk) by rows."""
    vector = lambda ant, p, t, ch, side, use: number(ant, p, *{"each": (t, ch), "channel": (0, ch), "all": (0, 0)}[spec.vary], 5, (0 if spec.same else side) + 2 * use)
    sign = lambda m, of, use: 1 if number(m, of, use, 5, 5) % 2 == 0 else -1
    out = np.zeros((spec.count, spec.snapshot_signs, spec.channel_signs, len(rows)), complex)
    for r, (t, ch, a, b, _, _, _, _, w, _) in enumerate(rows):
        for p in range(spec.count):
            c = np.exp(2j * math.pi / P.MODULUS * (vector(b, p, t, ch, 1, 0) - vector(a, p, t, ch, 0, 0)))
            if spec.kind == "gaussian":
                c *= math.sqrt(math.log((vector(a, p, t, ch, 0, 1) + 0.5) / P.MODULUS) * math.log((vector(b, p, t, ch, 1, 1) + 0.5) / P.MODULUS))
            for mb in range(spec.snapshot_signs):
                for mk in range(spec.channel_signs):
                    out[p, mb, mk, r] = w * spec.correction * c * sign(mb, t, 0) * sign(mk, ch, 1)
    return out


@pytest.mark.parametrize("spec", FORMS)
def test_measured_and_its_adjoint(spark, spec):
    rows = rows_of()
    vis = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], KIND + ", id int").repartition(3)
    dense = matrix(spec, rows)
    y = np.array([r[6] + 1j * r[7] for r in rows])
    got = {(r["p"], r["mb"], r["mk"]): r["re"] + 1j * r["im"] for r in P.measured(vis, spec).collect()}
    want = dense @ y
    assert set(got) == {*np.ndindex(want.shape)} and max(abs(got[k] - want[k]) for k in got) < 1e-9 * np.abs(want).max()
    # <MD W y, z> = <y, (MD W)* z>
    z = np.random.default_rng(1).normal(size=(*want.shape, 2)) @ [1, 1j]
    values = spark.createDataFrame([(*map(int, k), float(z[k].real), float(z[k].imag)) for k in np.ndindex(z.shape)], "p int, mb int, mk int, re double, im double")
    back = {r["id"]: r["weight"] * (r["re"] + 1j * r["im"]) for r in P.gridless(vis, values, spec).collect()}
    x = np.array([back[i] for i in range(len(rows))])
    assert abs(np.vdot(z, want) - np.vdot(x, y)) < 1e-9 * abs(np.vdot(z, want)) + 1e-9
    assert np.abs(x - np.tensordot(z, dense.conj(), 3)).max() < 1e-9


def test_image_of_projected_data(spark):
    rows = rows_of(80, 3)
    vis = spark.createDataFrame(rows, KIND)
    dense = matrix(SPEC, rows).reshape(-1, len(rows))
    axis = np.arange(8) - 4
    u, v = (np.array([r[k] for r in rows]) for k in (4, 5))
    waves = np.exp(1j * (v[:, None, None] * axis[None, :, None] + u[:, None, None] * axis[None, None, :]))
    y = np.array([r[6] + 1j * r[7] for r in rows])
    image = lambda data: (np.tensordot(dense.conj().T @ (dense @ data), waves, 1)).real
    found = P.dirty_image(vis, 8, SPEC).toPandas().set_index(["y", "x"]).sort_index()
    assert np.allclose(found["dirty"].to_numpy().reshape(8, 8), image(y), atol=1e-9 * np.abs(image(y)).max())
    assert np.allclose(found["psf"].to_numpy().reshape(8, 8), image(np.ones(len(rows))), atol=1e-9 * np.abs(image(y)).max())


def test_nothing_to_project(spark):
    vis = spark.createDataFrame(rows_of(40), KIND)
    none = vis.limit(0)
    assert P.measured(none, SPEC).count() == 0 and P.gridless(none, P.measured(vis, SPEC), SPEC).count() == 0
    back = P.gridless(vis, P.measured(none, SPEC), SPEC)
    assert back.count() == 40 and back.where("re <> 0 OR im <> 0").isEmpty()


def test_numbers_look_random(spark):
    at = [(a, p, t) for a in range(30) for p in range(20) for t in range(20)]
    df = spark.createDataFrame(at, "a int, p int, t int").select("a", "p", "t", F.expr(P.draw("a", "p", "t", 0, 1, 0)).alias("n"))
    got = {(r["a"], r["p"], r["t"]): r["n"] for r in df.collect()}
    n = P.drawn(*np.array(at).T, 0, 1, 0)
    assert [got[k] for k in at] == n.tolist() == [number(*k, 0, 1, 0) for k in at]
    x = n / P.MODULUS
    assert len(set(n.tolist())) > 0.99 * len(n) and abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / 12) < 0.002
    z = np.exp(2j * math.pi * x).reshape(30, 20, 20)
    for axis in range(3):  # neighbours tell nothing of each other
        assert abs((z.take(range(1, z.shape[axis]), axis) * z.take(range(z.shape[axis] - 1), axis).conj()).mean()) < 0.04
    assert abs((n % 2).mean() - 0.5) < 0.02


def test_energy_is_kept_on_average(spark):
    """Over several seeds the projected energy under the correction is that of the weighted rows."""
    rows = rows_of(60, 8)
    energy = sum(r[8] ** 2 * (r[6] ** 2 + r[7] ** 2) for r in rows)
    y = np.array([r[8] * (r[6] + 1j * r[7]) for r in rows])
    ratios = []
    for seed in range(200):
        rng = {k: np.array(v) for k, v in zip(("t", "ch", "ant1", "ant2"), list(zip(*rows))[:4])}
        spec = replace(SPEC, seed=seed)
        p = np.arange(spec.count)
        c = spec.coefficients(np.repeat(p, len(rows)), {k: np.tile(v, spec.count) for k, v in rng.items()}).reshape(spec.count, -1) * y
        sb = 1 - 2 * (P.drawn(np.arange(3)[:, None], rng["t"][None], 0, seed, 5) % 2)
        sk = 1 - 2 * (P.drawn(np.arange(2)[:, None], rng["ch"][None], 1, seed, 5) % 2)
        z = np.einsum("pr,br,kr->pbk", c, sb, sk) * spec.correction
        ratios.append((np.abs(z) ** 2).sum() / energy)
    assert abs(np.mean(ratios) - 1) < 0.1


def test_seeds_of_names(spark):
    names = ["a_id_7_x.mat", "a_id_7.mat", "a.mat", "_id_12", "x_id__id_3", "a_id_3_id_4_"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(P.seed_of(F.col("n"))).collect()] == [7, 1, 1, 12, 1, 3]
    assert {r[0] for r in df.select(P.seed_of(F.col("n"), 9)).collect()} == {9}
    with pytest.raises(ValueError):
        P.Projection(1, 1, 1, vary="none")
    with pytest.raises(ValueError):
        P.Projection(0, 1, 1)
