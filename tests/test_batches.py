"""Files are processed once each, through failures and restarts; exact one-dimensional clusters; further metrics."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.operators import visibility as V
from visloom.streaming import batches


def test_each_file_once(spark, tmp_path, monkeypatch):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for i in range(6):
        spark.range(i + 1).write.parquet(f"{src}/f{i}")
    bad = f"{src}/f3/bad.parquet"
    open(bad, "w").write("not a table")
    calls, named = [], batches.folder_of

    def killed(path):  # not a failure of the file: the query ends in the middle of a batch
        if len(calls) == 3:
            raise RuntimeError("killed")
        return named(path)

    def make(session, path):
        calls.append(path)
        return session.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))

    go = lambda: batches.process_files(spark, src, make, out, check, per_batch=2, pattern="*.parquet")
    monkeypatch.setattr(batches, "folder_of", killed)
    with pytest.raises(Exception, match="killed"):
        go()
    done = len(os.listdir(f"{out}/results"))
    assert 0 < done <= 3
    monkeypatch.setattr(batches, "folder_of", named)
    go()
    rows = spark.read.parquet(f"{out}/results/*").collect()
    files = [f"{d}/{x}" for d, _, names in os.walk(src) for x in names if x.endswith(".parquet")]
    assert len(rows) == len(files) - 1 == len(os.listdir(f"{out}/results")) and sum(r["n"] for r in rows) == 21
    errors = spark.read.parquet(f"{out}/errors").collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("bad.parquet")
    before = len(calls)
    go()
    assert len(calls) == before  # nothing new
    spark.range(5).write.parquet(f"{src}/f9")
    go()
    assert spark.read.parquet(f"{out}/results/*").agg(F.sum("n")).first()[0] == 26


def best_of_restarts(x, k, restarts=30):
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(restarts):
        c = np.sort(rng.choice(x, k, replace=False))
        for _ in range(100):
            at = np.abs(x[:, None] - c[None]).argmin(1)
            c = np.array([x[at == j].mean() if (at == j).any() else c[j] for j in range(k)])
        best = min(best, ((x - c[np.abs(x[:, None] - c[None]).argmin(1)]) ** 2).sum())
    return best


def test_clusters_of_least_cost(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, s, n) for m, s, n in ((-5, 1, 100), (0, 0.2, 300), (1, 0.3, 50), (9, 2, 150))])
    vis = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "w_m double").repartition(3)
    for k in (1, 3, 6):
        rows, centres = V.stacks_of_least_cost(vis, k)
        got = rows.where("w_m IS NOT NULL").toPandas()
        assert len(centres) == k and centres == sorted(centres) and rows.count() == len(x) + 1
        assert np.allclose(np.abs(got.w_m - got.w0), np.abs(got.w_m.to_numpy()[:, None] - np.array(centres)[None]).min(1))
        assert ((got.w_m - got.w0) ** 2).sum() <= best_of_restarts(x, k) * (1 + 1e-3)
    assert V.stacks_of_least_cost(vis.limit(0), 3)[1] == []
    same = spark.createDataFrame([(2.0,)] * 5, "w_m double")
    assert V.stacks_of_least_cost(same, 3)[1] == [2.0]
