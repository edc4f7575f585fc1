"""Block reduction, down-sampling, pyramids and intensity sums."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.voxel import masked
from voxlake.operators.blocks import Grid

REDUCTIONS = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "any": lambda c: F.max((F.col(c) != 0).cast("int"))}


def block_reduce(df: DataFrame, size: tuple[int, ...], shape: tuple[int, ...], how: str | Callable[[Column], Column] = "max", axes: tuple[str, ...] = ("z", "y", "x"), value: str = "v") -> DataFrame:
    """One value for each whole box of the given size; boxes that the volume cuts off are dropped.

    how is one of REDUCTIONS or a function from a column to any aggregate of it, such as F.median or a grouped
    pandas UDF. Coordinates become box numbers, and the aggregate combines before its shuffle if it can.
    """
    if not callable(how) and how not in REDUCTIONS:
        raise ValueError(f"unknown reduction {how}")
    reduced = how(F.col(value)) if callable(how) else REDUCTIONS[how](value)
    whole = [F.col(a) < (n // s) * s for a, n, s in zip(axes, shape, size, strict=True) if n % s]
    rows = reduce(lambda d, c: d.where(c), whole, df)
    boxes = [F.expr(f"cast({a} div {s} as bigint)").alias(a) for a, s in zip(axes, size, strict=True)]
    return rows.groupBy(*boxes).agg(reduced.alias(value))


def reduced_shape(size: tuple[int, ...], shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(n // s for n, s in zip(shape, size, strict=True))


def best_level(levels: list[int], wanted: int) -> int:
    """The stored pyramid level to start from: the wanted one, or the highest without a gap before it."""
    unbroken = -1
    while unbroken + 1 in levels:
        unbroken += 1
    if wanted in levels:
        return wanted
    return min(wanted, unbroken) if unbroken >= 0 else 0


def downsample(df: DataFrame, shape: tuple[int, int, int], by: int | tuple[int, int, int], how: str = "max", stored_level: int = 0, region: tuple[slice, slice, slice] | None = None) -> DataFrame:
    """Reduction by two to the power of by along each axis.

    df is level stored_level of a pyramid whose y and x are already halved that often. A region in
    full-size voxels narrows the read first; its y and x bounds are scaled to the level.
    """
    by = (by,) * 3 if isinstance(by, int) else by
    axes = ("z", "y", "x")
    if region is not None:
        new_shape = []
        for k, (a, s) in enumerate(zip(axes, region, strict=True)):
            scale = 1 if k == 0 else 2**stored_level
            start = (s.start or 0) // scale
            stop = shape[k] if s.stop is None else min(shape[k], s.stop // scale)
            df = df.where((F.col(a) >= start) & (F.col(a) < stop)).withColumn(a, F.col(a) - start)
            new_shape.append(stop - start)
        shape = tuple(new_shape)
    size = (2 ** by[0], 2 ** (by[1] - stored_level), 2 ** (by[2] - stored_level))
    return block_reduce(df, size, shape, how)


def pyramid_level(df: DataFrame, level: int) -> DataFrame:
    """Nearest voxels of a level: every 2**level-th along y and x."""
    step = 2**level
    if step == 1:
        return df
    near = (F.col("y") % step == 0) & (F.col("x") % step == 0)
    return df.where(near).withColumns({a: F.expr(f"cast({a} div {step} as bigint)") for a in ("y", "x")})


def pyramid(df: DataFrame, levels: int) -> DataFrame:
    """Levels 0 to levels in one relation with a level column; level 0 is read once.

    Every voxel is sent to the levels that hold it by generated rows, not by one pass a level.
    """
    deepest = reduce(lambda best, k: F.when((F.col("y") % 2**k == 0) & (F.col("x") % 2**k == 0), F.lit(k)).otherwise(best), range(1, levels + 1), F.lit(0))
    each = df.withColumn("level", F.explode(F.sequence(F.lit(0), deepest)))
    step = F.pow(F.lit(2.0), F.col("level"))
    return each.withColumns({a: F.floor(F.col(a) / step).cast("long") for a in ("y", "x")})


def intensity_by_block(df: DataFrame, grid: Grid, scale: float = 0.008, threshold: float = 0.0, value: str = "v") -> DataFrame:
    """Scaled sum of values over the threshold in each block, at the block's centre."""
    centre = [((F.col(f"s{a}") + (F.col(f"e{a}") - F.col(f"s{a}")) / 2).cast("double")).alias(f"c{a}") for a in grid.axes]
    spans = {f"s{a}": grid.start(k) for k, a in enumerate(grid.axes)} | {f"e{a}": grid.stop(k) for k, a in enumerate(grid.axes)}
    sums = grid.with_blocks(df).groupBy(*grid.keys).agg((F.sum(masked(F.col(value), threshold)) * scale).alias("ncells"))
    return sums.withColumns(spans).select(*grid.keys, *centre, "ncells")


def intensity_by_box(df: DataFrame, grid: Grid, width: int, scale: float = 0.008, threshold: float = 0.0, value: str = "v") -> DataFrame:
    """The same over boxes of the given width, counted from each block's start; cut-off boxes count as padded with zeros."""
    box: dict[str, Column] = {f"i{a}": F.floor((F.col(a) - grid.start(k)) / width).cast("int") for k, a in enumerate(grid.axes)}
    sums = grid.with_blocks(df).withColumns(box).groupBy(*grid.keys, *box).agg((F.sum(masked(F.col(value), threshold)) * scale).alias("ncells"))
    centre = [(grid.start(k) + (F.col(f"i{a}") + 0.5) * width).alias(f"c{a}") for k, a in enumerate(grid.axes)]
    return sums.select(*grid.keys, *box, *centre, "ncells")
