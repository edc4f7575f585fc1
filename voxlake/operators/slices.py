"""Slices along an axis, stacked neighbours, re-orientation, and weighted votes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.sources.volumes import AXES

#: Names of the planes and which source axis each target axis takes.
PLANES = {"yx": (0, 1, 2), "xz": (1, 2, 0), "zy": (2, 0, 1)}


#: Weights under this are rounding errors of the sine at the last slice.
LEAST_WEIGHT = 1e-9


def plane_names(triplanar: bool) -> list[str]:
    return list(PLANES) if triplanar else ["yx"]


def transposed(df: DataFrame, order: tuple[int, ...], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Axis k of the result is axis order[k] of df."""
    rest = [c for c in df.columns if c not in axes]
    return df.select(*[F.col(axes[o]).alias(a) for a, o in zip(axes, order, strict=True)], *rest)


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=lambda k: order[k]))


def stacked(df: DataFrame, step: int, depth: int) -> DataFrame:
    """Three channels of every slice with both neighbours: v0, v1, v2 from slices j, j + step, j + 2 step.

    Rows are dense along z, so the neighbours come from one window over each column of voxels.
    """
    w = Window.partitionBy("y", "x").orderBy("z")
    three = df.select(F.col("z"), "y", "x", F.col("v").alias("v0"), F.lead("v", step).over(w).alias("v1"), F.lead("v", 2 * step).over(w).alias("v2"))
    return three.where(F.col("z") < depth - 2 * step)


def unstacked(slices: DataFrame, step: int, depth: int) -> DataFrame:
    """The volume that stacked slices came from: first channels at the bottom, middle ones, last ones on top."""
    n = depth - 2 * step
    bottom = slices.where(F.col("z") < step).select("z", "y", "x", F.col("v0").alias("v"))
    middle = slices.select((F.col("z") + step).alias("z"), "y", "x", F.col("v1").alias("v"))
    top = slices.where(F.col("z") >= n - step).select((F.col("z") + 2 * step).alias("z"), "y", "x", F.col("v2").alias("v"))
    return bottom.unionByName(middle).unionByName(top)


def edge_window(at: Column, length: int, weight: float) -> Column:
    """Less weight for first and last slices: half a sine over the axis."""
    return weight * F.sin(F.lit(math.pi) * at / F.lit(float(max(1, length - 1))))


def vote(predictions: list[DataFrame], weights: list[float] | None = None, edge_axes: list[tuple[str, int]] | None = None, limit: float = 256.0) -> DataFrame:
    """z, y, x, seg: whether the weighted mean of normalised predictions is above 0.

    Each prediction is clipped and divided by its own population deviation; edge_axes names for each
    the axis and its length along which border slices weigh less; a weight under LEAST_WEIGHT counts as
    none, and a voxel that no prediction weighs is background.
    """
    weights = weights or [1.0] * len(predictions)
    parts = []
    for k, (p, w) in enumerate(zip(predictions, weights, strict=True)):
        v = F.least(F.greatest(F.col("v").cast("double"), F.lit(-limit)), F.lit(limit))
        spread = p.agg(F.stddev_pop(v).alias("__sd"))
        wk = edge_window(F.col(edge_axes[k][0]), edge_axes[k][1], w) if edge_axes else F.lit(w)
        wk = F.when(F.abs(wk) < LEAST_WEIGHT, 0.0).otherwise(wk)
        parts.append(p.join(F.broadcast(spread)).select(*AXES, (F.try_divide(v, F.col("__sd")) * wk).alias("wv"), wk.alias("w")))
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy(*AXES).agg(F.coalesce(F.try_divide(F.sum("wv"), F.sum("w")) > 0, F.lit(False)).alias("seg"))
