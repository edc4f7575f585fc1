"""Multi-step pipelines over volumes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.voxel import above, bias_corrected, clipped, half_rounded
from voxlake.operators.blocks import Grid, block_totals
from voxlake.operators.labels import label
from voxlake.operators.objects import count_by_size, objects_global
from voxlake.operators.reduction import block_reduce
from voxlake.sources.volumes import AXES
from voxlake.storage import cached

#: The production run's threshold and counting parameters.
PRODUCTION = {"threshold": 0.45, "min_size": 8, "size_threshold": 200.0, "volume_weight": 5.15e-3, "params": (3.0, -0.5, 2.3)}


@dataclass(frozen=True)
class Counting:
    threshold: float = 0.2
    min_size: int = 0
    size_threshold: float = 2.0
    volume_weight: float = 0.25
    params: tuple[float, float, float] = (3.0, -0.5, 2.0)


def upsampled_join(fine: DataFrame, coarse: DataFrame, factor: tuple[int, ...], value: str, axes: tuple[str, ...] = AXES) -> DataFrame:
    """fine with the coarse volume's value at each voxel; coarse voxels span factor fine ones."""
    keys = [f"__{a}" for a in axes]
    small = coarse.select(*[F.col(a).alias(k) for a, k in zip(axes, keys, strict=True)], value)
    at = {k: F.expr(f"cast({a} div {f} as bigint)") for a, k, f in zip(axes, keys, factor, strict=True)}
    return fine.withColumns(at).join(small, keys, "left").drop(*keys)


def apply_bias(image: DataFrame, bias: DataFrame, factor: tuple[int, ...]) -> DataFrame:
    """image (v) divided by a coarser bias field (b), as sixteen-bit values."""
    return upsampled_join(image, bias, factor, "b").select(*AXES, bias_corrected(F.col("v"), F.col("b")).alias("v"))


def pixel_multiplier(negative: DataFrame, bias: DataFrame, factor: tuple[int, ...]) -> DataFrame:
    """One over the bias where the negative mask (v 0 or 1, dense) is clear, 0 under the mask."""
    joined = upsampled_join(negative, bias, factor, "b")
    return joined.select(*AXES, F.try_divide(1.0 - F.col("v"), F.col("b")).alias("m"))


def normalised(image: DataFrame, multiplier: DataFrame, factor: tuple[int, ...], max_value: float) -> DataFrame:
    """image times multiplier (m, coarser by factor), clipped to 0..1 of max_value and rounded to half precision."""
    joined = upsampled_join(image, multiplier, factor, "m")
    scaled = clipped(F.col("v").cast("double") * F.coalesce("m", F.lit(0.0)) / max_value, 0, 1)
    return joined.select(*AXES, half_rounded(scaled).alias("v"))


def count_cells(spark: SparkSession, volume: DataFrame, grid: Grid, how: Counting = Counting(), stages: str | None = None) -> DataFrame:
    """One row for each object: its centroid and estimated cells.

    Threshold, labels and objects follow from one another lazily; with stages, a folder URI, the mask and the
    objects are committed there and a later run starts from them.
    """
    mask = cached(spark, lambda: volume.where(above(F.col("v"), how.threshold)).select(*grid.axes), f"{stages}/mask") if stages else volume.where(above(F.col("v"), how.threshold)).select(*grid.axes)

    def objects() -> DataFrame:
        return objects_global(label(spark, mask, grid), grid, how.min_size)

    found = cached(spark, objects, f"{stages}/objects") if stages else objects()
    return count_by_size(found, grid, how.min_size, how.size_threshold, how.volume_weight, how.params)


@dataclass(frozen=True)
class Production:
    """Parameters of the whole run: reduction, highest value that is not artefact, bias boxes, and the counting."""

    factor: tuple[int, int, int] = (2, 2, 2)
    artefact: float = 1250.0
    bias_boxes: tuple[int, int, int] = (4, 4, 4)
    max_value: float = 1000.0
    counting: Counting = Counting()


def box_bias(image: DataFrame, boxes: tuple[int, int, int], max_value: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """A coarse bias field (b): mean of each box over max_value. A stand-in for estimators that are not this engine's."""
    at = [F.expr(f"cast({a} div {n} as bigint)").alias(a) for a, n in zip(axes, boxes, strict=True)]
    return image.groupBy(*at).agg((F.sum("v").cast("double") / F.count("*").cast("double") / F.lit(float(max_value))).alias("b"))


def polynomial_bias(image: DataFrame, grid: Grid, degree: int = 2) -> DataFrame:
    """image's least-squares polynomial in its coordinates (b), over its mean: a smooth bias field for each voxel.

    The normal equations are one aggregate of fixed size, whatever the volume.
    """
    from itertools import product

    import numpy as np

    powers = [p for p in product(range(degree + 1), repeat=grid.ndim) if sum(p) <= degree]
    unit = [F.col(a) / F.lit(float(max(1, n - 1))) for a, n in zip(grid.axes, grid.shape, strict=True)]

    def term(p: tuple[int, ...]) -> Column:
        out = F.lit(1.0)
        for u, k in zip(unit, p, strict=True):
            for _ in range(k):
                out = out * u
        return out

    v = F.col("v").cast("double")
    pairs = {tuple(a + b for a, b in zip(p, q, strict=True)) for p in powers for q in powers}
    sums = image.agg(F.avg(v).alias("mean"), *[F.sum(term(p)).alias("m" + "_".join(map(str, p))) for p in sorted(pairs)], *[F.sum(term(p) * v).alias("r" + "_".join(map(str, p))) for p in powers]).first()
    left = np.array([[sums["m" + "_".join(str(a + b) for a, b in zip(p, q, strict=True))] for q in powers] for p in powers])
    weights = np.linalg.lstsq(left, np.array([sums["r" + "_".join(map(str, p))] for p in powers]), rcond=None)[0] / (sums["mean"] or 1.0)
    field = F.lit(0.0)
    for p, w in zip(powers, weights.tolist(), strict=True):
        field = field + term(p) * w
    return image.select(*grid.axes, field.alias("b"))


def obtain_bias(spark: SparkSession, estimate: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """The bias field that estimate gives, kept at path and read from there ever after."""
    return cached(spark, estimate, path) if path else estimate()


def production(spark: SparkSession, image: DataFrame, grid: Grid, how: Production = Production(), bias: Callable[[DataFrame], DataFrame] | None = None, stages: str | None = None) -> dict[str, DataFrame]:
    """The whole run: reduce, mask artefacts, correct the bias, threshold, label, measure, count.

    grid is that of the reduced volume. With stages, a folder URI, the reduced and the corrected volume, the
    mask and the objects are committed there, and a later run starts after the last of them.
    """

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return cached(spark, make, f"{stages}/{name}") if stages else make()

    whole = tuple(n * f for n, f in zip(grid.shape, how.factor, strict=True))
    small = stage("reduced", lambda: block_reduce(image, how.factor, whole, "max"))
    field = obtain_bias(spark, lambda: (bias or (lambda v: box_bias(v, how.bias_boxes, how.max_value)))(small), f"{stages}/bias" if stages else None)
    clean = small.withColumn("v", F.when(F.col("v") > how.artefact, F.lit(0)).otherwise(F.col("v")))
    corrected = stage("corrected", lambda: apply_bias(clean, field, how.bias_boxes))
    objects = count_cells(spark, corrected, grid, how.counting, stages)
    return {"reduced": small, "bias": field, "corrected": corrected, "cells": objects, "totals": block_totals(objects, grid)}


def cells_per_block(spark: SparkSession, volume: DataFrame, grid: Grid, how: Counting = Counting(), stages: str | None = None) -> DataFrame:
    return block_totals(count_cells(spark, volume, grid, how, stages), grid)
