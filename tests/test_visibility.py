import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.functions import columns as C
from visloom.operators import fourier, gridding, visibility as V, wavelets
from visloom.plans import config, imager, queries as plans, solvers
from visloom.sources import channels as H, fits, tables as T
from visloom.streaming.averaging import averaged_stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).head()


def test_soft_threshold_and_its_dual_add_up(spark):
    rows = spark.createDataFrame([(-3.0,), (-0.5,), (0.2,), (2.0,)], "z double").select(C.soft(F.col("z"), 1.0).alias("s"), C.soft_dual(F.col("z"), 1.0).alias("d")).collect()
    assert [r["s"] for r in rows] == [-2, 0, 0, 1] and [r["d"] for r in rows] == [-1, -0.5, 0.2, 1]


def test_cells_wrap(spark):
    r = one(spark, a=C.cell(F.lit(-math.pi), 64), b=C.cell(F.lit(0.0), 64), c=C.cell(F.lit(3.1), 64))
    assert tuple(r) == (63, 31, 62)


def test_averaging_factors(spark):
    vis = spark.createDataFrame([(0, 1, 100.0, 0.0), (0, 2, 250.0, 0.0), (1, 2, 1000.0, 0.0), (3, 4, 0.0, 0.0)], "ant1 int, ant2 int, u_m double, v_m double")
    f = {(r["ant1"], r["ant2"]): (r["n_t"], r["n_f"]) for r in V.averaging_factors(vis, 8, 4).collect()}
    assert f == {(0, 1): (8, 4), (0, 2): (4, 4), (1, 2): (1, 1), (3, 4): (8, 4)}


def test_averaging_by_one_is_identity(spark):
    vis = spark.createDataFrame([(0, 1, t, ch, 1.0 + t, 2.0, 3.0, float(ch), 1.0, 2.0, False) for t in range(3) for ch in range(2)], "ant1 int, ant2 int, t int, ch int, u_m double, v_m double, w_m double, re double, im double, nw double, flagged boolean")
    out = V.averaged(vis, V.averaging_factors(vis, 1, 1), T.channels(spark), 3, 2)
    assert out.count() == 6
    assert out.where("n <> 1 OR abs(nw - 2) > 1e-12 OR abs(re - f_bin) > 1e-12 OR t_end - t_start <> 1").count() == 0


def test_uniform_weights_sum_to_one_a_cell(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "p int, q int")
    sums = V.uniform_weights(rows).groupBy("p", "q").agg(F.sum(F.col("nwimag") ** 2).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_briggs_golden(spark):
    rows = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0)], "p int, q int, nw double")
    w = {r["p"]: r["nwimag"] for r in V.briggs_weights(rows, 0.0).collect()}
    assert w[0] == pytest.approx(0.18133398) and w[1] == pytest.approx(0.34600334)


def test_reconstruction_lowers_the_residual(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-3, 3, 400), rng.uniform(-3, 3, 400)
    truth = {(0, 0): 1.0, (2, -3): 0.5}
    y = sum(a * np.exp(-1j * (u * x + v * yy)) for (yy, x), a in truth.items())
    rows = spark.createDataFrame([tuple(map(float, r)) + (1.0,) for r in zip(u, v, y.real, y.imag)], "u double, v double, re double, im double, weight double")
    image = imager.reconstruct(rows, imager.Settings(side=8))
    m = imager.metrics(image).head()
    assert m["residual_norm"] < 0.2 * m["dirty_norm"]
    best = {(r["y"], r["x"]): r["model"] for r in image.collect()}
    assert min(best.values()) >= 0 and best[(0, 0)] == pytest.approx(1, abs=0.1) and best[(2, -3)] == pytest.approx(0.5, abs=0.1)


def test_empty_shelf_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text("")
    with pytest.raises(ValueError):
        T.shelf(spark, str(tmp_path / "s.csv"))


def _samples(spark, count=400, seed=1):
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(-3, 3, count), rng.uniform(-3, 3, count)
    truth = {(0, 0): 1.0, (2, -3): 0.5}
    y = sum(a * np.exp(-1j * (u * x + v * yy)) for (yy, x), a in truth.items())
    schema = "u double, v double, re double, im double, weight double"
    return spark.createDataFrame([tuple(map(float, r)) + (1.0,) for r in zip(u, v, y.real, y.imag)], schema), truth


def test_adjoint_matches_forward(spark):
    rows, _ = _samples(spark, 50)
    rows = rows.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0)], rows.schema))
    image = np.random.default_rng(3).normal(size=(6, 6))
    kept = fourier.predicted(rows.na.drop(), image)
    left = kept.select(F.sum(F.col("re") * F.col("re_model") + F.col("im") * F.col("im_model"))).first()[0]
    back = {(r["y"], r["x"]): r["dirty"] for r in fourier.dirty_image(rows, 6).collect()}
    assert left == pytest.approx(sum(back[(y - 3, x - 3)] * image[y, x] for y in range(6) for x in range(6)))
    assert fourier.predicted(rows, image).where("u is null and re_model is null").count() == 1


def test_fourier_sums_of_no_rows(spark):
    rows, _ = _samples(spark, 2)
    assert fourier.dirty_image(rows.where("false"), 4).count() == 0
    assert fourier.predicted(rows.where("false"), np.ones((4, 4))).count() == 0
    with pytest.raises(ValueError):
        fourier.dirty_image(rows, fourier.MAX_SIDE + 1)


def _close_to(image, truth):
    best = {(r["y"], r["x"]): r["model"] for r in image.collect()}
    assert min(best.values()) >= 0
    assert all(best[at] == pytest.approx(v, abs=0.1) for at, v in truth.items())


def test_reweighted_reconstruction(spark):
    rows, truth = _samples(spark)
    image = solvers.reweighted_sparse(rows, 8)
    m = imager.metrics(image).head()
    assert m["residual_norm"] < 0.1 * m["dirty_norm"]
    _close_to(image, truth)


def test_denoised_reconstruction_picks_from_the_shelf(spark):
    rows, truth = _samples(spark)
    image = solvers.denoised(rows, 8, [1e-3, 1e-2, 1e-1], lambda x, sigma: np.where(x > sigma, x, 0))
    _close_to(image, truth)
    assert {r["sigma"] for r in image.collect()} <= {1e-3, 1e-2, 1e-1}
    assert solvers.pick(T.SHELF, 3e-5) == (2e-5, 2e-5, 4e-5)
    assert solvers.pick(T.SHELF, 1e-6) == (2.5e-6, 0.0, 2.5e-6)
    assert solvers.pick(T.SHELF, 1.0) == (3.2e-4, 3.2e-4, math.inf)


def test_constrained_reconstruction(spark):
    rows, truth = _samples(spark, 200)
    image = solvers.constrained(rows, 8, 0.5, lambda x: np.maximum(x, 0), solvers.Rounds(inner=12))
    m = imager.metrics(image).head()
    assert m["residual_norm"] < 0.3 * m["dirty_norm"]


def test_constrained_equals_a_dual_value_per_visibility(spark):
    rows, _ = _samples(spark, 60)
    table = rows.withColumn("weight", F.lit(1.0) + F.abs("u")).toPandas()
    at = [(y, x) for y in range(-3, 3) for x in range(-3, 3)]
    root = np.sqrt(table.weight.to_numpy())
    phi = root[:, None] * np.exp(-1j * (np.outer(table.u, [x for _, x in at]) + np.outer(table.v, [y for y, _ in at])))
    y = root * (table.re.to_numpy() + 1j * table.im.to_numpy())
    vis = spark.createDataFrame(table)
    gamma, x, dual = 0.5 / np.linalg.norm((phi.conj().T @ phi).real, 2), np.zeros(36), np.zeros(60, complex)
    for _ in range(25):
        before, x = x, np.maximum(x - gamma * (phi.conj().T @ dual).real, 0)
        q = dual + phi @ (2 * x - before) - y
        dual = q * (1 - min(1, 2.0 / np.linalg.norm(q)))
    image = solvers.constrained(vis, 6, 2.0, lambda v: np.maximum(v, 0), solvers.Rounds(inner=25))
    got = {(r["y"], r["x"]): r for r in image.collect()}
    assert np.allclose([got[k]["model"] for k in at], x, rtol=1e-3, atol=1e-4) and {(r["rounds"], r["settled"]) for r in got.values()} == {(25, False)}


def test_constrained_meets_its_radius(spark):
    rows, _ = _samples(spark, 200)
    image = solvers.constrained(rows, 8, 0.5, lambda x: np.maximum(x, 0))
    model = imager.as_array(image, "model", 8)
    ahead = fourier.predicted(rows, model)
    gap = ahead.agg(F.sum((F.col("re") - F.col("re_model")) ** 2 + (F.col("im") - F.col("im_model")) ** 2)).first()[0]
    assert math.sqrt(gap) <= 0.5 * (1 + 1e-5) and image.where("settled AND rounds >= 200").count() == 64


def test_reweighted_says_when_its_limit_came_first(spark):
    rows, _ = _samples(spark)
    assert solvers.reweighted_sparse(rows, 8).where("settled").count() == 64
    assert solvers.reweighted_sparse(rows, 8, solvers.Rounds(inner=3, outer=1)).where("settled OR rounds <> 1").count() == 0


def test_dictionary_keeps_the_norm_and_inverts():
    words, x = solvers.Dictionary(16), np.random.default_rng(5).normal(size=(16, 16))
    c = words.analysis(x)
    assert np.linalg.norm(c) == pytest.approx(np.linalg.norm(x))
    assert np.allclose(words.synthesis(c), x)


def test_quarter_turns_and_mirrors_undo(spark):
    rows = spark.range(8).select(F.col("id").alias("vec_id"), (F.col("id") % 4).cast("int").alias("turns"), (F.col("id") >= 4).alias("flip"))
    image = rows.crossJoin(spark.range(16).select((F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.col("id").cast("double").alias("v")))
    turned = wavelets.oriented(image, 4)
    grid = np.arange(16.0).reshape(4, 4)
    for r in turned.collect():
        want = np.rot90(grid[:, ::-1] if r["flip"] else grid, r["turns"])
        assert want[r["y"], r["x"]] == r["v"]
    assert wavelets.oriented(turned, 4, back=True).exceptAll(image.select(*turned.columns)).count() == 0


def test_fits_round_trip(spark, tmp_path):
    image = np.random.default_rng(2).normal(size=(3, 5))
    (tmp_path / "a.fits").write_bytes(fits.encode(image))
    (tmp_path / "b.fits").write_bytes(fits.encode(image * 2))
    rows = fits.read_images(spark, str(tmp_path / "*.fits"))
    assert rows.count() == 30
    back = {r["path"]: fits.decode(bytes(r["content"])) for r in fits.files_of(rows).collect()}
    assert sorted(np.round(b / image, 9).max() for b in back.values()) == [1, 2]
    with pytest.raises(ValueError):
        fits.decode(b" " * 2880)


def test_stream_averages_by_window(spark, tmp_path):
    schema = "ts timestamp, ant1 int, ant2 int, ch int, re double, im double, nw double, flagged boolean"
    rows = [("2024-01-01 00:00:01", 1.0, 1.0, False), ("2024-01-01 00:00:09", 4.0, 2.0, False), ("2024-01-01 00:00:12", 7.0, 1.0, False), ("2024-01-01 00:00:13", 99.0, 1.0, True)]
    df = spark.createDataFrame([(t, 0, 1, 0, re, 0.0, nw, f) for t, re, nw, f in rows], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    out = averaged_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n"], r["re"]) for r in spark.table("averages").orderBy("start").collect()] == [(2, pytest.approx(3.4)), (1, 7.0)]


def test_gridded_sums_equal_exact_ones(spark):
    rng = np.random.default_rng(3)
    data = [(int(i % 2), float(u), float(v), float(a), float(b), 1.0 + float(abs(a))) for i, (u, v, a, b) in enumerate(zip(*rng.uniform(-math.pi, math.pi, (2, 300)), *rng.normal(size=(2, 300))))]
    rows = spark.createDataFrame(data + [(0, None, 0.0, 1.0, 1.0, 1.0)], "ch int, u double, v double, re double, im double, weight double")
    for ch in (0, 1):
        want = {(r["y"], r["x"]): r for r in fourier.dirty_image(rows.where(f"ch = {ch}"), 16).collect()}
        got = gridding.dirty_image(rows, 16, ["ch"]).where(f"ch = {ch}").collect()
        peak = max(r["psf"] for r in want.values())
        assert len(got) == 256 and max(abs(r[c] - want[r["y"], r["x"]][c]) for r in got for c in ("dirty", "psf")) < 1e-5 * peak
    image = rng.normal(size=(16, 16))
    exact = {r["u"]: r for r in fourier.predicted(rows, image).collect()}
    for r in gridding.predicted(rows, image).collect():
        if r["u"] is None:
            assert r["re_model"] is None
        else:
            assert abs(r["re_model"] - exact[r["u"]]["re_model"]) < 1e-4 and abs(r["im_model"] - exact[r["u"]]["im_model"]) < 1e-4


def test_images_are_solved_by_key(spark):
    one, truth = _samples(spark)
    rows = one.withColumn("ch", F.lit(0)).unionByName(one.withColumns({"ch": F.lit(1), "re": 2 * F.col("re"), "im": 2 * F.col("im")}))
    found = imager.reconstruct(rows, imager.Settings(side=8), keys=["ch"])
    peaks = {r["ch"]: r["m"] for r in found.groupBy("ch").agg(F.max("model").alias("m")).collect()}
    assert peaks[1] == pytest.approx(2 * peaks[0], rel=1e-2) and found.count() == 128
    assert imager.reconstruct(rows.where("ch > 5"), imager.Settings(side=8)).count() == 0


def test_constrained_denoiser_meets_its_radius(spark):
    rows, truth = _samples(spark, 200)
    image = solvers.constrained_denoised(rows, 8, 0.5, [1e-3, 1e-2], lambda x, sigma: np.where(x > sigma, x, 0))
    _close_to(image, truth)
    assert image.where("settled AND sigma IS NOT NULL").count() == 64


def test_channel_files_and_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.0, 0.0, None, False), (2, 0, 2.0, 0.0, 3.0, True), (2, 1, 4.0, 0.0, 3.0, False), (9, 1, 5.0, 0.0, 1.0, False)], "row long, ch int, re double, im double, nw double, flagged boolean")
    main = spark.createDataFrame([(1, 0, 0, 1, 30.0, 40.0), (2, 0, 0, 2, 60.0, 80.0)], "row long, t int, ant1 int, ant2 int, u_m double, v_m double")
    H.write_channel_files(rows, str(tmp_path / "c"))
    back = H.read_channel_files(spark, str(tmp_path / "c"), 2, base=1)
    assert {r["row"] for r in back.collect()} == {2, 9}
    found = {(r["row"], r["ch"]): r for r in H.with_geometry(H.read_channel_files(spark, str(tmp_path / "c")), main, H.frequencies(spark, T.LIGHT, T.LIGHT, 2)).collect()}
    assert set(found) == {(1, 0), (2, 1)} and found[1, 0]["nw"] == 1.0 and found[2, 1]["u"] == 120.0 and found[2, 1]["w"] == 0.0
    with pytest.raises(ValueError):
        H.channel_range(rows, 0, base=1)


def _zero_mode(v, low):
    """One level along the first axis by the definition: c[k] = sum of d[m] x[2k + 1 - m] with reversed taps."""
    dec, n = low[::-1], len(v)
    return np.array([sum((d * v[2 * k + 1 - m] for m, d in enumerate(dec) if 0 <= 2 * k + 1 - m < n), np.zeros(v.shape[1:])) for k in range((n + len(low) - 1) // 2)])


def test_zero_mode_levels_and_thresholded_synthesis(spark):
    image = np.random.default_rng(7).normal(size=(6, 6))
    long = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(6) for x in range(6)], "vec_id int, y int, x int, v double")
    orders = [1, 2, 4]
    words = wavelets.dictionary(long, 6, 2, orders, "zero")
    got = {(r["basis"], r["level"], r["band"], r["y"], r["x"]): r["v"] for r in words.collect()}
    want, matrices = {}, {o: [] for o in orders}
    for o in orders:
        low, s = wavelets.daubechies(o), image
        for level in (1, 2):
            eye = np.eye(len(s))
            lo, hi = _zero_mode(eye, np.array(low)), _zero_mode(eye, np.array(wavelets.high_pass(low)))
            matrices[o].append((lo, hi))
            for band, a, b in (("ll", lo, lo), ("lh", lo, hi), ("hl", hi, lo), ("hh", hi, hi)):
                if band != "ll" or level == 2:
                    want |= {(o, level, band, y, x): v / 2 for (y, x), v in np.ndenumerate(a @ s @ b.T)}
            s = lo @ s @ lo.T
    want |= {(0, 0, "dirac", y, x): v / 2 for (y, x), v in np.ndenumerate(image)}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12
    cut = {k: math.copysign(max(abs(v) - 0.1, 0), v) for k, v in want.items()}
    total = np.array([[cut[0, 0, "dirac", y, x] for x in range(6)] for y in range(6)])
    for o in orders:
        s = None
        for level in (2, 1):
            lo, hi = matrices[o][level - 1]
            c = lambda band, n=len(lo): np.array([[cut[o, level, band, y, x] for x in range(n)] for y in range(n)])
            s = lo.T @ (c("ll") if s is None else s) @ lo + lo.T @ c("lh") @ hi + hi.T @ c("hl") @ lo + hi.T @ c("hh") @ hi
        total = total + s
    found = wavelets.from_dictionary(words.withColumn("v", C.soft(F.col("v"), 0.1)), 6, 2, orders, "zero")
    assert all(abs(r["v"] - total[r["y"], r["x"]] / 2) < 1e-12 for r in found.collect()) and found.count() == 36
    same = wavelets.from_dictionary(words, 6, 2, orders, "zero").collect()
    assert all(abs(r["v"] - image[r["y"], r["x"]]) < 1e-9 for r in same)


def test_padding_of_short_signals(spark):
    for size in (1, 3):
        for mode, name in (("constant", "edge"), ("periodic", "wrap"), ("symmetric", "symmetric"), ("reflect", "reflect"), ("zero", "constant")):
            signal = spark.createDataFrame([(0, i, float(i + 1)) for i in range(size)], "vec_id int, i int, v double")
            got = {r["i"]: r["v"] for r in wavelets.padded(signal, size, 5, 4, mode).collect()}
            assert [got[i] for i in range(-5, size + 4)] == list(np.pad(np.arange(1.0, size + 1), (5, 4), mode=name)), (mode, size)


def test_ellipse_projection_with_a_warm_start(spark):
    rng = np.random.default_rng(2)
    x, c, p = (rng.normal(size=40) * 3 + 1j * rng.normal(size=40) for _ in range(3))
    w = rng.choice([0.5, 1.0, 2.0], 40)
    rows = spark.createDataFrame([(0, *[float(f(a[i])) for a in (x, c, p) for f in (np.real, np.imag)], float(w[i]), i) for i in range(40)], "ch int, re double, im double, re0 double, im0 double, re_prev double, im_prev double, precond double, i int")
    radius = 0.3 * math.sqrt(40 + 2 * math.sqrt(40))
    d = p
    for _ in range(10):
        d = d - w / 4 * (d - x)
        d = c + (d - c) * min(1, radius / np.linalg.norm(d - c))
    got = {r["i"]: complex(r["re"], r["im"]) for r in V.projected_on_ellipse(rows, ["ch"], 0.3).collect()}
    assert max(abs(got[i] - d[i]) for i in range(40)) < 1e-9
    inside = V.projected_on_ellipse(rows.drop("re_prev", "im_prev"), ["ch"], 1e6, most=200)
    assert max(abs(complex(r["re"], r["im"]) - x[r["i"]]) for r in inside.collect()) < 1e-3


def test_odd_sides_need_a_step_of_their_own(spark):
    vis = spark.createDataFrame([(0.1, 0.2, 1.0, 0.0, 1.0)], "u double, v double, re double, im double, weight double")
    with pytest.raises(ValueError, match="even"):
        imager.reconstruct(vis, imager.Settings(side=5))
    free = imager.reconstruct(vis, imager.Settings(side=5, iterations=3, least=1), prox=lambda x: np.maximum(x, 0))
    assert free.count() == 25


def test_projection_sizes():
    eps, p, b, k = V.projection_sizes(512 * 512, 27, 200, 16)
    assert eps**4 - eps**3 / 27 == pytest.approx(2 * 512**2 / (27**2 * 200 * 16)) and p * (p - 1) / 2 * b * k >= 512**2
    eps, p, b, k = V.projection_sizes(1000, 10, 10, 10, same=False)
    assert eps**4 == pytest.approx(1000 / (10**2 * 10 * 10)) and p * p * b * k >= 1000


def test_parameters_fall_back(tmp_path):
    (tmp_path / "c.json").write_text('[{"main": {"algorithm": "usara", "src_name": "a"}}, {"flag": {"x": 1, "_comment_x": "c"}, "weighting": {"weight_type": "natural"}, "computing": {}, "nufft": {}, "usara": {"im_max_itr": -1}, "usara_default": {}}]')
    found = config.load(str(tmp_path / "c.json"), {"src_name": "b", "other": 3, "dnn_shelf_path": None})
    assert found == {"algorithm": "usara", "src_name": "b", "x": 1, "weight_type": "natural", "im_max_itr": -1}
    checked = config.Imaging.checked(found)
    assert checked.weight_type == "briggs" and checked.im_max_itr == 2000
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"), {"algorithm": "none"})
    assert config.prefix("usara", "a", run=2) == "a_usara_run_2"


def test_blocks_of_images_equal_joins_on_odd_images(spark, monkeypatch):
    """Null, missing, infinite and repeated pixels, a null id and images cut by Arrow batches: the same rows as by joins."""
    rng, rows = np.random.default_rng(3), []
    for k in [*range(12), None]:
        rows += [(k, y, x, float(v)) for (y, x), v in np.ndenumerate(rng.normal(size=(8, 8)))]
    rows = [r for r in rows if not (r[0] == 2 and r[1] < 5) and not (r[0] == 3 and r[1:3] != (7, 0))]
    rows = [(k, y, x, None if (k == 4 and y > 2) or k == 5 else math.inf if (k, y, x) == (6, 3, 3) else v) for k, y, x, v in rows]
    rows += [r for r in rows if r[0] == 7] + [(8, 1, 1, 0.5)]
    long = spark.createDataFrame(rows, "vec_id long, y int, x int, v double").repartition(3)
    orders, size = [1, 2, 5], 8
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    weight = lambda y, x: 1 + 0.37 * y + 0.11 * x
    digest = lambda words: words.groupBy("vec_id", "basis", "level", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") ** 2).alias("energy"), F.sum(F.col("v") * weight(F.col("y"), F.col("x"))).alias("moment"))

    def collected(df):
        values = [c for c, t in df.dtypes if t == "double"]
        found = [(tuple(r[c] for c in sorted(df.columns) if c not in values), tuple(r[c] for c in values)) for r in df.collect()]
        assert len({k for k, _ in found}) == len(found)
        return dict(found)

    def same(a, b):
        assert set(a) == set(b)
        for k, left in a.items():
            for one, two in zip(left, b[k]):
                assert (one is None) == (two is None) and (one is None or one == two or (math.isnan(one) and math.isnan(two)) or abs(one - two) < 1e-11), (k, left, b[k])

    def plain(images, levels, mode):
        """Rows of every coefficient, by joins with the taps."""
        monkeypatch.setattr(wavelets, "WHOLE", 0)
        words = wavelets.dictionary(images, size, levels, orders, mode)
        found = collected(wavelets.analysis(images, orders, size, levels, mode)), collected(digest(words))
        cut = wavelets.from_dictionary(words.withColumn("v", C.soft(F.col("v"), 0.1)), size, levels, orders, mode)
        found = *found, collected(cut), collected(wavelets.synthesis(words, orders, size, levels, mode))
        monkeypatch.undo()
        return found

    try:
        for mode, levels in (("periodic", 2), ("zero", 2)):
            analysed, sums, cut, back = plain(long, levels, mode)
            same(collected(wavelets.analysis(long, orders, size, levels, mode)), analysed)
            same(collected(wavelets.band_sums(long, size, levels, orders, mode, weight)), sums)
            same(collected(wavelets.thresholded(long, size, levels, orders, 0.1, mode)), cut)
            words = wavelets.dictionary(long, size, levels, orders, mode)
            same(collected(wavelets.synthesis(words, orders, size, levels, mode)), back)
            unscaled = {k: tuple(None if v is None else v / 2 for v in vs) for k, vs in collected(wavelets.resynthesised(long, orders, size, levels, mode)).items()}
            same(unscaled, back)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_coefficients_of_images_are_no_shuffled_rows(spark):
    """A band's sums and thresholded images come from one shuffle of pixels and one of results, without joins."""
    images = T.images(spark, "/root/testdata/sf0.001")
    for found in (wavelets.band_sums(images, 8, 4, [1, 8], "zero"), wavelets.thresholded(images, 8, 4, [1, 8], 0.02, "zero"), wavelets.resynthesised(images, [2, 5], 8)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 0 and plan.count("Aggregate") <= 2


def test_averaging_shuffles_sums_and_no_rows(spark):
    """Whatever is shuffled was summed in the task that read it; a null coordinate has no part in a mean."""
    vis = spark.createDataFrame([(0, 1, t, c, 10.0 if t else None, 0.0, 0.0, 2.0 * t, 1.0, 1.0 + c, False) for t in range(2) for c in range(2)] + [(0, 2, 0, 0, None, 30.0, 0.0, 1.0, 1.0, 1.0, False)], "ant1 int, ant2 int, t int, ch int, u_m double, v_m double, w_m double, re double, im double, nw double, flagged boolean")
    factors = spark.createDataFrame([(0, 1, 2, 2), (0, 2, 1, 1)], "ant1 int, ant2 int, n_t int, n_f int")
    found = V.averaged(vis, factors.groupBy("ant1", "ant2").agg(F.max("n_t").alias("n_t"), F.max("n_f").alias("n_f")), T.channels(spark), 2, 2)
    plan = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if " Sort [" not in x]
    under = [b for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning" in a]
    assert under and all("Aggregate" in x for x in under)
    got = {r["ant2"]: r for r in found.collect()}
    u = 10 * sum(f for c, f in T.CHANNELS[:2]) / 2 / T.LIGHT
    assert got[1]["n"] == 4 and got[1]["u"] == pytest.approx(u) and got[1]["re"] == pytest.approx(1.0) and got[1]["nw"] == pytest.approx(math.sqrt(10)) and got[1]["sum_re"] == 4
    assert got[2]["u"] is None and got[2]["v"] == pytest.approx(30 * T.CHANNELS[0][1] / T.LIGHT) and got[2]["n"] == 1


def test_no_shuffle_by_channel(spark):
    """A table of a few channels, whose size Spark does not know, meets the rows where they are."""
    vis = T.visibilities(spark, "/root/testdata/sf0.001")
    main = vis.select(F.monotonically_increasing_id().alias("row"), "t", "ant1", "ant2", "u_m", "v_m", "w_m")
    rows = vis.select(F.monotonically_increasing_id().alias("row"), "ch", "re", "im", "nw", "flagged")
    for found in (V.in_wavelengths(vis, T.channels(spark)), H.with_geometry(rows, main, T.channels(spark))):
        assert "hashpartitioning(ch" not in found._jdf.queryExecution().executedPlan().toString()
    assert plans.queries()["bda_image_error"](spark, "/root/testdata/sf0.001").first()["n_full"] == vis.where("NOT flagged").count()
