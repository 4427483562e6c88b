"""Images too large for one task, as a table of lines: gridded Fourier sums, w stacks, and the operator's norm.

A line is one row (keys, line, v): ``v`` holds the real and imaginary parts of a row or column of an image or grid, one after another.
A two-dimensional transform is a transform of every line, a transposing shuffle of blocks (BLOCK columns of all lines meet, so a group
has BLOCK times the side values), and a transform of every line again.  No task holds an image, and nothing passes through the driver.

The forward map gathers from the transformed grid by tiles: a tile of TILE x TILE cells (and the kernel's reach) meets the rows whose
kernels start in it.  The rows of a crowded tile are dealt to parts of about PART rows, and the tile goes to each of them.

Rows with a null take no part in sums, and their model is null; so is that of rows with a null key.  Rows whose keys have no image get zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visloom.operators import gridding
from visloom.operators.gridding import OVER, WIDTH, transform_of_bell
from visloom.storage import discard, written

BLOCK = 64
TILE = 128
PART = 200_000


def _complex(column: pa.Array) -> np.ndarray:
    """Lines of one length as a complex matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1).view(np.complex128) if len(column) else np.zeros((0, 0), complex)


def _lists(z: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(z, np.complex128).view(np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in keys), rest])


def mapped(lines: DataFrame, keys: list[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every line through ``f``, which takes and gives a matrix of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(f(_complex(b.column(len(keys) + 1))))], [*keys, "line", "v"])

    return lines.select(*keys, "line", "v").mapInArrow(run, _schema(lines, keys, "line int, v array<double>"))


def transposed(lines: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Columns become lines; ``height`` is the number of lines, of which those that are zero may be absent."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _complex(b.column(len(keys) + 1))
            for k in range(0, z.shape[1], BLOCK):
                block = pa.array(np.full(b.num_rows, k // BLOCK, np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], block, _lists(z[:, k : k + BLOCK])], [*keys, "line", "block", "v"])

    def turn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        z = _complex(table.column("v").chunk(0))
        out = np.zeros((z.shape[1], height), complex)
        out[:, table.column("line").to_numpy()] = z.T
        first = key[-1].as_py() * BLOCK
        names = [*keys, "line", "v"]
        same = [pa.array([k.as_py()] * len(out), k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*same, pa.array(first + np.arange(len(out), dtype=np.int32)), _lists(out)], names)

    pieces = lines.select(*keys, "line", "v").mapInArrow(cut, _schema(lines, keys, "line int, block int, v array<double>"))
    return pieces.groupBy(*keys, "block").applyInArrow(turn, _schema(lines, keys, "line int, v array<double>"))


def lines_of(values: DataFrame, keys: list[str], line: str, at: str, size: int, re: str, im: str | None = None) -> DataFrame:
    """Lines of ``size`` from long rows (keys, line, at, re, im); what is absent is zero."""
    part = F.collect_list(F.struct(F.col(at).cast("int").alias("at"), F.col(re).cast("double").alias("re"), (F.col(im).cast("double") if im else F.lit(0.0)).alias("im")))
    rows = values.groupBy(*keys, F.col(line).cast("int").alias("line")).agg(part.alias("v"))  # ``size`` values each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(len(keys) + 1)
            row, e = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            z = np.zeros((b.num_rows, size), complex)
            z[row, e.field("at").to_numpy()] = e.field("re").to_numpy() + 1j * e.field("im").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(z)], [*keys, "line", "v"])

    return rows.mapInArrow(run, _schema(rows, keys, "line int, v array<double>"))


def pixels(lines: DataFrame, keys: list[str], side: int, name: str) -> DataFrame:
    """(keys, y, x, name): the real part of image lines (line = column x, counted from 0)."""
    real = F.expr(f"transform(sequence(0, {side - 1}), i -> v[2 * i])")
    rows = lines.select(*keys, (F.col("line") - side // 2).alias("x"), F.posexplode(real).alias("i", name))
    return rows.select(*keys, (F.col("i") - side // 2).alias("y"), "x", name)


def _back(side: int) -> np.ndarray:
    return (np.arange(side) - side // 2) % (OVER * side)


def image_lines(grid: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Image (line = column x) from the lines gy of a grid of OVER * side cells a side, complex."""
    n, shape, back = OVER * side, transform_of_bell(side), _back(side)

    def axis(z: np.ndarray) -> np.ndarray:
        return (np.fft.ifft(z, axis=1) * n)[:, back] / shape

    return mapped(transposed(mapped(grid, keys, axis), keys, n), keys, axis)


def grid_lines(image: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Lines gy of the transformed image (line = column x): the adjoint of ``image_lines``."""
    n, shape, back = OVER * side, transform_of_bell(side), _back(side)

    def axis(z: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(z), n), complex)
        wide[:, back] = z / shape
        return np.fft.fft(wide, axis=1)

    return mapped(transposed(mapped(image, keys, axis), keys, side), keys, axis)


def dirty_lines(vis: DataFrame, side: int, keys: list[str], what: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Image lines of the sums of each name in ``what`` (its real and imaginary cell sums of ``gridding.spread``), under the key ``what``."""
    cells = written(gridding.spread(vis, side, keys), "tiled-cells")
    parts = [cells.select(*keys, "gy", "gx", F.lit(k).alias("what"), F.col(re).alias("re"), (F.col(im) if im else F.lit(0.0)).alias("im")) for k, (re, im) in what.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return image_lines(lines_of(both, [*keys, "what"], "gy", "gx", OVER * side, "re", "im"), [*keys, "what"], side)


def dirty_image(vis: DataFrame, side: int, keys: list[str] = []) -> DataFrame:
    """keys, y, x, dirty, psf of rows (keys, u, v in [-pi, pi], re, im, weight): what ``gridding.dirty_image`` gives, for any side."""
    found = written(dirty_lines(vis, side, keys, {"dirty": ("re", "im"), "psf": ("weight", None)}), "tiled-image")
    one = {k: pixels(found.where(F.col("what") == k), keys, side, k) for k in ("dirty", "psf")}
    return one["dirty"].join(one["psf"], [*keys, "y", "x"])


def _first(axis: str, cells: int) -> Column:
    """The first cell that the kernel of a coordinate reaches, before it is wrapped."""
    return F.ceil(F.col(axis).cast("double") * (cells / (2 * math.pi)) - WIDTH / 2)


def tiles_of(grid: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, ty, tx, tile): squares of TILE cells and the WIDTH after them, from the lines gy of a periodic grid."""
    reach, many = TILE + WIDTH, -(-cells // TILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _complex(b.column(len(keys) + 1))
            for k in range(many if b.num_rows else 0):
                at = (k * TILE + np.arange(reach)) % cells
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(b.num_rows, k, np.int32)), _lists(z[:, at])], [*keys, "line", "tx", "v"])

    pieces = grid.select(*keys, "line", "v").mapInArrow(cut, _schema(grid, keys, "line int, tx int, v array<double>"))
    # the tiles that a line is in, and its place there
    steps = F.expr(f"filter(flatten(transform(sequence(0, {many - 1}), k -> transform(sequence(0, {-(-reach // cells)}), w -> named_struct('ty', k, 'at', line + w * {cells} - k * {TILE})))), s -> s.at >= 0 and s.at < {reach})")
    rows = pieces.select(*keys, "tx", F.explode(steps).alias("s"), "v").select(*keys, "tx", "s.ty", "s.at", "v")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = np.zeros((reach, reach), complex)
        out[table.column("at").to_numpy()] = _complex(table.column("v").chunk(0))
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), _lists(out.reshape(1, -1))], [*keys, "ty", "tx", "tile"])

    return rows.groupBy(*keys, "ty", "tx").applyInArrow(join, _schema(grid, keys, "ty int, tx int, tile array<double>"))


def gathered(vis: DataFrame, grid: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Adds re_model, im_model: the grid of the row's keys, gathered under the kernel at (u, v in [-pi, pi])."""
    cells = OVER * side
    tile = lambda a: F.floor(F.pmod(_first(a, cells), F.lit(cells)) / TILE).cast("int")
    placed = vis.withColumns({"ty": tile("v"), "tx": tile("u")})
    by = [*keys, "ty", "tx"]
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    known = placed.where(whole)
    sizes = written(known.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "tiled-parts")
    tiles = tiles_of(grid, keys, cells).join(sizes, by)
    tiles = tiles.select(*by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tile")
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in vis.columns if c not in keys])
    dealt = known.join(sizes, by).withColumn("part", F.pmod(mixed, F.col("parts").cast("long")).cast("int")).drop("parts")
    own = list(vis.columns)
    names = [*own, "re_model", "im_model"]

    def gather(rows: pa.Table, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        u, v = (rows.column(c).to_numpy().astype(np.float64) * (cells / (2 * math.pi)) for c in "uv")
        total = np.zeros(len(u), complex)
        if table.num_rows:
            part = _complex(table.column("tile").chunk(0))[0].reshape(TILE + WIDTH, -1)
            first = [np.ceil(p - WIDTH / 2) for p in (v, u)]
            place = [((f % cells) % TILE).astype(np.int64) for f in first]
            weight = [[gridding._bell((p - f - j) * (2 / WIDTH)) for j in range(WIDTH)] for p, f in zip((v, u), first)]
            for j in range(WIDTH):
                for i in range(WIDTH):
                    total += part[place[0] + j, place[1] + i] * (weight[0][j] * weight[1][i])
        return pa.Table.from_arrays([*(rows.column(c) for c in own), pa.array(total.real.copy()), pa.array(total.imag.copy())], names)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in vis.dtypes), "re_model double, im_model double"])
    found = dealt.groupBy(*by, "part").cogroup(tiles.groupBy(*by, "part")).applyInArrow(gather, schema)
    rest = placed.where(~whole).select(*vis.columns, F.lit(None).cast("double").alias("re_model"), F.lit(None).cast("double").alias("im_model"))
    return found.unionByName(rest)


def predicted(vis: DataFrame, image: DataFrame, side: int, keys: list[str] = []) -> DataFrame:
    """Adds re_model, im_model from images as rows (keys, y, x, v): what ``gridding.predicted`` gives, for any side and many images."""
    moved = image.select(*keys, (F.col("y") + side // 2).alias("y"), (F.col("x") + side // 2).alias("x"), "v")
    grid = grid_lines(lines_of(moved, keys, "x", "y", side, "v"), keys, side)
    return gathered(vis, written(grid, "tiled-grid"), keys, side)


def _bend(side: int, pixel: float, sign: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(lines z, their columns x, their w0) -> z times exp(sign 2 pi i w0 (n - 1)) / n."""

    def f(z: np.ndarray, x: np.ndarray, w0: np.ndarray) -> np.ndarray:
        y = (np.arange(side) - side // 2) * pixel
        n = np.sqrt(1 - ((x - side // 2) * pixel)[:, None] ** 2 - y[None, :] ** 2)
        return z * np.exp(sign * 2j * math.pi * w0[:, None] * (n - 1)) / n

    return f


def _bent(lines: DataFrame, keys: list[str], side: int, pixel: float, sign: float) -> DataFrame:
    """Image lines with the w term of their stack (w0 is among the keys)."""
    bend, at = _bend(side, pixel, sign), keys.index("w0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = bend(_complex(b.column(len(keys) + 1)), b.column(len(keys)).to_numpy(), b.column(at).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(z)], [*keys, "line", "v"])

    return lines.select(*keys, "line", "v").mapInArrow(run, _schema(lines, keys, "line int, v array<double>"))


def stacked_image(vis: DataFrame, side: int, pixel: float, keys: list[str] = []) -> DataFrame:
    """keys, y, x, dirty with the w term of each row's stack (columns stack, w0): cells are keyed by stack, each stack's image is bent.

    What ``fourier.stacked_image`` gives, for any side and number of images.
    """
    by = [*keys, "stack", "w0"]
    rows = vis.withColumns({"stack": F.col("stack").cast("int"), "w0": F.col("w0").cast("double")}).na.drop(subset=["stack", "w0"])
    lines = dirty_lines(rows, side, by, {"dirty": ("re", "im")}).drop("what")
    flat = pixels(_bent(lines, by, side, pixel, 1.0), by, side, "dirty")
    return flat.groupBy(*keys, "y", "x").agg(F.sum("dirty").alias("dirty"))


def stacked_predicted(vis: DataFrame, image: DataFrame, side: int, pixel: float, keys: list[str] = []) -> DataFrame:
    """Adds re_model, im_model of w-stacked rows (columns stack, w0) from images (keys, y, x, v): the adjoint of ``stacked_image``."""
    by = [*keys, "stack", "w0"]
    stacks = vis.select(*by).na.drop(subset=["stack", "w0"]).distinct()  # a few an image
    moved = image.select(*keys, (F.col("y") + side // 2).alias("y"), (F.col("x") + side // 2).alias("x"), "v")
    lines = lines_of(moved, keys, "x", "y", side, "v")
    common = keys or ["one"]  # every stack needs the whole image
    if not keys:
        stacks, lines = stacks.withColumn("one", F.lit(1)), lines.withColumn("one", F.lit(1))
    each = stacks.join(lines, common)
    grid = grid_lines(_bent(each.select(*by, "line", "v"), by, side, pixel, -1.0), by, side)
    return gathered(vis, written(grid, "tiled-grid"), by, side)


# the norm of the operator


def _spectrum(kernel: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Lines fy of the transformed kernel of twice the side (line = column x)."""
    turn = lambda z: np.fft.fft(np.fft.ifftshift(z.real, axes=1), axis=1)
    across = lambda z: np.fft.fft(np.fft.ifftshift(z, axes=1), axis=1)
    return mapped(transposed(mapped(kernel, keys, turn), keys, 2 * side), keys, across)


def convolved(image: DataFrame, spectrum: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Image lines (line = column x) under the kernel of this spectrum (line, s)."""
    wide = lambda z: np.fft.fft(z, 2 * side, axis=1)
    narrow = lambda z: np.fft.ifft(z, axis=1)[:, :side]
    over = mapped(transposed(mapped(image, keys, wide), keys, side), keys, wide)
    both = over.join(spectrum, [*keys, "line"])

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = narrow(_complex(b.column(len(keys) + 1)) * _complex(b.column(len(keys) + 2)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], _lists(z)], [*keys, "line", "v"])

    back = both.select(*keys, "line", "v", "s").mapInArrow(times, _schema(over, keys, "line int, v array<double>"))
    return mapped(transposed(back, keys, 2 * side), keys, lambda z: narrow(z).real.astype(complex))


def _dot(a: str, b: str) -> Column:
    return F.sum(F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (acc, x) -> acc + x)"))


def operator_norms(vis: DataFrame, side: int, keys: list[str], tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """Largest eigenvalue of the adjoint times the forward map of rows (keys, u, v, weight): keys, norm, norm_prime, rounds, settled.

    ``weight`` is the squared weight of a row (natural, imaging and preconditioning weights together); ``norm_prime`` takes its square.
    Rows are read once: they are reduced to the kernel of the product, which depends on pixel differences only.  Each round of Lanczos's
    iteration is then a convolution of line tables, written to the shared folder, for all images and both kinds at once; the driver
    holds two numbers a round and image.  It ends when the residual of each largest Ritz value is at most ``tolerance`` of that value, which
    bounds the eigenvalue's error; the start is noise, so that no eigenvector is left out by symmetry.  After ``most`` rounds ``settled`` is false for those that are not there.
    """
    by = [*keys, "what"]
    zeros = vis.withColumns({"re": F.lit(0.0), "im": F.lit(0.0)})
    kernel = dirty_lines(zeros, 2 * side, keys, {"norm": ("weight", None), "norm_prime": ("square", None)})
    spectrum = written(_spectrum(kernel, by, side).withColumnRenamed("v", "s"), "norm-spectrum")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = np.array([np.random.default_rng(line).normal(size=side) for line in b.column(len(by)).to_pylist()], complex)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(z), _lists(z)], [*by, "line", "v", "prev"])

    rows = spectrum.where(F.col("line") < side).select(*by, "line", "s")
    first = written(rows.mapInArrow(start, _schema(rows, by, "line int, v array<double>, prev array<double>")), "norm-start")
    now = first.select(*by, "line", "prev", "v", F.col("v").alias("w"))
    squares = first.groupBy(*by).agg(_dot("v", "v").alias("n")).collect()  # one row an image
    # of each image: multiples of v and of prev that the last product loses, and the norm of what is left
    state = {tuple(r[k] for k in by): (0.0, 0.0, math.sqrt(r["n"])) for r in squares}
    alphas: dict[tuple, list[float]] = {k: [] for k in state}
    betas: dict[tuple, list[float]] = {k: [] for k in state}
    found: dict[tuple, tuple[float, int, bool]] = {}
    steps: list[DataFrame] = []
    numbers = _schema(first, by, "a double, b double, c double")
    for step in range(1, most + 1):
        if len(found) == len(state):
            break
        scalars = F.broadcast(vis.sparkSession.createDataFrame([(*k, a, b, 1 / n if n else 0.0) for k, (a, b, n) in state.items()], numbers))  # one row an image
        unit = now.join(scalars, by).select(*by, "line", F.expr("transform(w, (x, i) -> c * (x - a * v[i] - b * prev[i]))").alias("v"), F.col("v").alias("prev"))
        done = convolved(unit.select(*by, "line", "v"), spectrum, by, side).withColumnRenamed("v", "w")
        now = written(unit.join(done, [*by, "line"]), "norm-round")
        for r in now.groupBy(*by).agg(_dot("w", "v").alias("a"), _dot("w", "w").alias("ww")).collect():  # one row an image
            k = tuple(r[c] for c in by)
            a, b = r["a"], betas[k][-1] if betas[k] else 0.0
            alphas[k].append(a)
            left = math.sqrt(max(0.0, r["ww"] - a * a - b * b))
            values, vectors = np.linalg.eigh(np.diag(alphas[k]) + np.diag(betas[k], 1) + np.diag(betas[k], -1))
            near = left * abs(vectors[-1, -1]) <= tolerance * abs(values[-1])
            if k not in found and (near or step == most):
                found[k] = (float(values[-1]), step, bool(near))
            betas[k].append(left)
            state[k] = (a, b, left)
        discard(*steps)
        steps = [now]
    discard(first, spectrum, *steps)
    kinds = dict(vis.select(*keys).dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "what string, value double, rounds int, settled boolean"])
    rows = vis.sparkSession.createDataFrame([(*k, *v) for k, v in found.items()], schema)
    pick = lambda name: F.max(F.when(F.col("what") == name, F.col("value")))
    return rows.groupBy(*keys).agg(pick("norm").alias("norm"), pick("norm_prime").alias("norm_prime"), F.max("rounds").alias("rounds"), F.min("settled").alias("settled"))

