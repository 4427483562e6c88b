"""Channel files with a shared geometry, and extraction from an exported main table.

The main file holds one row a snapshot and antenna pair (key ``row``: t, ant1, ant2, u_m, v_m, w_m); each channel file holds
that channel's values by the same key.  Files are Parquet partitioned by ``ch``, so a range of channels prunes files and each file is a
task of its own.  Channel rows meet the geometry by their key: the order of rows in a file has no meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from visloom.functions import columns as C
from visloom.sources import arrays, mat5
from visloom.sources.sink import write_files

GEOMETRY = """
select o_orderkey as row, cast(o_orderkey % 64 as int) as t, cast(o_custkey % 27 as int) as ant1,
       cast(o_custkey % 27 + 1 + o_orderkey % 5 as int) as ant2, round((o_custkey % 27 - 13) * 30e0 + o_orderkey % 7, 6) as u_m,
       round((o_custkey % 41 - 20) * 25e0 + o_orderkey % 3, 6) as v_m, round((o_orderkey % 101 - 50) * 3e0, 6) as w_m
from {source}
"""

CHANNEL_ROWS = """
select l_orderkey as row, l_linenumber - 1 as ch, round(l_extendedprice/10000, 6) as re, round(l_tax*10 - 0.4e0, 6) as im,
       case when l_linenumber % 3 = 0 then null else round(0.5e0 + l_discount*10, 6) end as nw, l_returnflag = 'R' as flagged
from {source}
"""

MAIN_TABLE = """
select l_orderkey as row, cast(l_suppkey % 3 as int) as field_id, l_returnflag = 'R' as flag_row,
       array((l_suppkey % 27 - 13) * 30e0 + l_quantity, (l_partkey % 41 - 20) * 25e0, (l_orderkey % 101 - 50) * 3e0) as uvw,
       transform(array(0, 1), c -> transform(array(0, 1, 2, 3), p -> named_struct(
           're', case when l_quantity = 7 then 0e0 else round(l_extendedprice/10000 + c + p, 6) end,
           'im', case when l_quantity = 7 then 0e0 else round(l_tax*10 - p, 6) end))) as data,
       transform(array(0, 1), c -> transform(array(0, 1, 2, 3), p -> l_discount*10 + 1 + c + p)) as weight_spectrum,
       transform(array(0, 1), c -> transform(array(0, 1, 2, 3), p -> (l_partkey + c + 2*p) % 11 = 0)) as flag
from {source}
"""


def _derived(spark: SparkSession, sf_dir: str, table: str, select: str) -> DataFrame:
    return spark.sql(select.format(source="{base}"), base=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main file of the given tables: one row an order."""
    return _derived(spark, sf_dir, "orders", GEOMETRY)


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel values of the given tables: channel = line number; every third channel has no natural weights."""
    return _derived(spark, sf_dir, "lineitem", CHANNEL_ROWS)


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported main table of the given tables: arrays by channel and correlation."""
    return _derived(spark, sf_dir, "lineitem", MAIN_TABLE)


def write_channel_files(rows: DataFrame, path: str) -> None:
    """One folder a channel; a channel's rows are spread over tasks, so a large channel has several files."""
    rows.write.mode("overwrite").partitionBy("ch").parquet(path)


def read_channel_files(spark: SparkSession, path: str, first: int | None = None, count: int | None = None, base: int = 0) -> DataFrame:
    """The files of ``count`` channels from number ``first`` on, which counts from ``base`` (0 or 1); all without a range.

    A channel without rows has no folder and is left out.
    """
    return channel_range(spark.read.parquet(path), first, count, base)


def channel_range(rows: DataFrame, first: int | None = None, count: int | None = None, base: int = 0) -> DataFrame:
    """A first channel alone means that channel; a count alone means the channels from the start on."""
    if first is None and count is None:
        return rows
    low = 0 if first is None else first - base
    if low < 0 or (count is not None and count < 1):
        raise ValueError("a range starts at its base and holds a channel or more")
    return rows.where((F.col("ch") >= low) & (F.col("ch") < low + (count or 1)))


def write_mat_files(rows: DataFrame, main: DataFrame, path: str) -> None:
    """Channel rows and the main table as MAT files: ``path``/channels and ``path``/main, several files a channel where tasks share it."""
    y = F.struct("re", "im").alias("y")
    write_files(mat5.files_of(rows.select(F.col("row").alias("key"), "ch", y, "nw", "flagged"), "ch", "data"), f"{path}/channels")
    write_files(mat5.files_of(main.withColumn("part", F.lit(0)).withColumnRenamed("row", "key"), "part", "main"), f"{path}/main")


def read_mat_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channel rows and the main table that ``write_mat_files`` wrote; a weight that is no number is null."""
    rows = arrays.table(spark, mat5.MatSource, f"{path}/channels", columns=["key", "ch", "y", "nw", "flagged"], rows="key")
    main = arrays.table(spark, mat5.MatSource, f"{path}/main", columns=["key", "t", "ant1", "ant2", "u_m", "v_m", "w_m"], rows="key")
    rows = rows.select(F.col("key").alias("row"), "ch", "y.re", "y.im", F.nanvl("nw", F.lit(None).cast("double")).alias("nw"), "flagged")
    return rows, main.withColumnRenamed("key", "row")


def frequencies(spark: SparkSession, first_hz: float, step_hz: float, count: int) -> DataFrame:
    """A channel table of even spacing: ch, freq_hz."""
    return spark.range(count).select(F.col("id").cast("int").alias("ch"), (F.lit(first_hz) + F.col("id") * step_hz).alias("freq_hz"))


def with_geometry(rows: DataFrame, main: DataFrame, freqs: DataFrame) -> DataFrame:
    """Unflagged channel rows with u, v, w in wavelengths, the weight 1 where none is stored, and w = 0 where the main file has none.

    Flags are applied before the join, and only used columns reach it.  Rows whose key the main file lacks are left out.  The
    channels, one row each, are broadcast: shuffled by channel, all rows would meet in a few tasks.
    """
    if "w_m" not in main.columns:
        main = main.withColumn("w_m", F.lit(0.0))
    nw = F.coalesce(F.col("nw"), F.lit(1.0)) if "nw" in rows.columns else F.lit(1.0)
    kept = rows.where("NOT flagged").select("row", "ch", "re", "im", nw.alias("nw"))
    joined = kept.join(main.select("row", "t", "ant1", "ant2", "u_m", "v_m", "w_m"), "row").join(F.broadcast(freqs), "ch")
    return joined.withColumns({a: C.wavelengths(F.coalesce(f"{a}_m", F.lit(0.0)), F.col("freq_hz")) for a in "uvw"}).drop("u_m", "v_m", "w_m")


def longest_baseline(rows: DataFrame) -> DataFrame:
    """One row: longest projected baseline in wavelengths and the pixel size (arcsec) at nominal resolution."""
    far = F.max(F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))
    return rows.agg(far.alias("longest"), (F.lit(180 * 3600 / 3.141592653589793) / (2 * far)).alias("pixel_arcsec"))


def extracted(main: DataFrame, field: int, channel: int, freq_hz: float) -> DataFrame:
    """Stokes I of one field and channel: row, u, v, w (wavelengths), re, im, nw, and nwimag where imaging weights are stored.

    The first and last correlations are combined by their weights (the spectrum, else one weight a row).  A row goes if either is
    flagged, the row is flagged, or the combined value is zero.  ``corrected_data`` is taken where present.
    """
    names = set(main.columns)
    both = lambda c: (F.element_at(c, 1), F.element_at(c, -1))
    d1, d4 = both(F.col("corrected_data" if "corrected_data" in names else "data")[channel])
    w1, w4 = both(F.col("weight_spectrum")[channel] if "weight_spectrum" in names else F.col("weight"))
    f1, f4 = both(F.col("flag")[channel])
    imaging = F.col("imaging_weight")[0] if "imaging_weight" in names else F.element_at(F.col("imaging_weight_spectrum")[channel], 1) if "imaging_weight_spectrum" in names else None
    mix = lambda part: (w1 * d1[part] + w4 * d4[part]) / (w1 + w4)
    axes = {a: C.wavelengths(F.col("uvw")[i], F.lit(freq_hz)) for i, a in enumerate("uvw")}
    more = [] if imaging is None else [F.sqrt(imaging).alias("nwimag")]
    rows = main.where((F.col("field_id") == field) & ~(F.col("flag_row") | f1 | f4))
    rows = rows.select("row", *[c.alias(a) for a, c in axes.items()], mix("re").alias("re"), mix("im").alias("im"), F.sqrt(w1 + w4).alias("nw"), *more)
    return rows.where("NOT (re = 0 AND im = 0)")
