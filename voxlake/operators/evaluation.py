"""Scores of masks and counts against a reference."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dice(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """One row: twice the common foreground over the sum of both; null if both are empty.

    a and b hold foreground voxels. Both are tagged and meet in one aggregate by voxel, so neither
    side needs to fit anywhere.
    """
    tagged = a.select(*axes, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(*axes, F.lit(0).alias("a"), F.lit(1).alias("b")))
    voxels = tagged.groupBy(*axes).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = voxels.agg(F.sum(F.col("a") * F.col("b")).alias("common"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return sums.select("common", "n_a", "n_b", F.try_divide(2.0 * F.col("common"), F.col("n_a") + F.col("n_b")).alias("dice"))


def mean_absolute_error(df: DataFrame, counted: str, truth: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(counted).cast("double") - F.col(truth))).alias("mae"))


def density_curve(df: DataFrame, column: str, low: float, high: float, points: int = 101) -> DataFrame:
    """i, x, density: a Gaussian kernel estimate with Scott's bandwidth at evenly spaced points.

    Each row adds to all points, with partial sums by point before the shuffle; the points are few and
    fixed, whatever the input.
    """
    v = F.col(column).cast("double")
    stats = df.where(v.isNotNull()).agg(F.count("*").alias("n"), F.stddev_samp(v).alias("sd"))
    with_h = stats.select("n", (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    spot = F.lit(low) + F.col("i") / F.lit(float(points - 1)) * F.lit(high - low)
    each = df.where(v.isNotNull()).join(F.broadcast(with_h)).select("n", "h", v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    z = (spot - F.col("v")) / F.col("h")
    summed = each.groupBy("i").agg(F.sum(F.exp(-0.5 * z * z)).alias("s"), F.first(F.col("n") * F.col("h")).alias("nh"))
    return summed.select("i", spot.alias("x"), (F.col("s") / (F.col("nh") * math.sqrt(2 * math.pi))).alias("density"))
