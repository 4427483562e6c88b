"""Input tables: visibilities and their dimension tables, and small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Speed of light (m/s), channel frequencies (Hz), noise levels of a denoiser shelf.
LIGHT = 299792458.0
CHANNELS = [(0, 1.000e9), (1, 1.008e9), (2, 1.016e9), (3, 1.024e9)]
SHELF = [2.5e-6, 5e-6, 1e-5, 2e-5, 4e-5, 8e-5, 1.6e-4, 3.2e-4]

VIS_SELECT = """
select cast(l_suppkey % 27 as int) as ant1, cast((l_suppkey % 27) + 1 + (l_partkey % 5) as int) as ant2,
       cast(l_orderkey % 64 as int) as t, cast(l_linenumber % 4 as int) as ch,
       round((l_suppkey % 27 - 13) * 30e0 + l_quantity, 6) as u_m, round((l_partkey % 41 - 20) * 25e0 + l_discount*100, 6) as v_m,
       round((l_orderkey % 101 - 50) * 3e0, 6) as w_m, round(l_extendedprice/10000, 6) as re, round(l_tax*10 - 0.4e0, 6) as im,
       round(0.5e0 + l_discount*10, 6) as nw, l_returnflag = 'R' as flagged
from {source}
"""


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visibility: keys ant1, ant2, t, ch; coordinates in metres; re, im; nw = 1/sigma; flagged."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(VIS_SELECT.format(source="{lineitem}"), lineitem=lineitem)


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNELS, "ch int, freq_hz double")


def shelf(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Noise level and network path of each denoiser; from a headerless CSV if a path is given."""
    if path is not None:
        found = spark.read.schema("sigma double, path string").csv(path)
        if found.isEmpty():
            raise ValueError(f"no denoiser in {path}")
        return found
    return spark.createDataFrame([(s, f"net_{i}") for i, s in enumerate(SHELF)], "sigma double, path string")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long 8 x 8 images (vec_id, y, x, v) from the 64 values of each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = e.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return long.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def antenna_pair_index(q: int) -> str:
    """SQL for the index of a pair p < q among q antennas, upper triangle row by row."""
    return f"cast(ant1 * {q} - ant1 * (ant1 + 1) / 2 + (ant2 - ant1 - 1) as int)"
