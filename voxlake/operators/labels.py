"""Connected-component labelling of a sparse mask, face connectivity.

A component's label is the linear index of its smallest voxel, so labels do not depend on chunks
or partitions. Each chunk labels its own voxels with a vectorised kernel; the distinct pairs of labels
that meet across chunk faces are the edges of a graph whose components join them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.voxel import linear_id
from voxlake.operators.blocks import Grid, exclusive_offsets, map_blocks
from voxlake.operators.graph import components
from voxlake.storage import written


def label_points(points: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """For each point of an (n, d) array, the linear index of the smallest point it is connected with."""
    strides = np.cumprod([1, *shape[::-1]])[::-1][1:].astype(np.int64)
    ids = points.astype(np.int64) @ strides
    order = np.argsort(ids)
    ids = ids[order]
    pairs = []
    for axis, stride in enumerate(strides.tolist()):
        at = np.searchsorted(ids, ids + stride)
        at[at == len(ids)] = 0
        inside = points[order, axis] + 1 < shape[axis]
        hit = np.flatnonzero((ids[at] == ids + stride) & inside)
        pairs.append((hit, at[hit]))
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(ids), np.int64)
    out[order] = ids[label]
    return out


def local_labels(mask: DataFrame, grid: Grid) -> DataFrame:
    """axes, block keys, and a label that is unique over all chunks but not joined across them."""
    fields = ", ".join([f"{a} long" for a in grid.axes] + [f"{k} int" for k in grid.keys] + ["lbl long"])

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(lbl=label_points(rows[list(grid.axes)].to_numpy(), grid.shape))

    return map_blocks(mask.select(*grid.axes), grid, label, fields)


def seam_edges(local: DataFrame, grid: Grid) -> DataFrame:
    """Distinct pairs (a, b) of labels that touch across a face between two chunks.

    Only voxels on chunk faces take part, so the join is over surfaces, not volumes.
    """
    parts = []
    for k, axis in enumerate(grid.axes):
        low = local.where((F.col(axis) == grid.start(k)) & (F.col(axis) > 0)).select(*grid.axes, F.col("lbl").alias("a"))
        high = local.where(F.col(axis) == grid.stop(k) - 1).select(*[(F.col(x) + 1).alias(x) if x == axis else F.col(x) for x in grid.axes], F.col("lbl").alias("b"))
        parts.append(low.join(high, list(grid.axes)).select("a", "b"))
    return reduce(DataFrame.unionAll, parts).distinct()


def label(spark: SparkSession, mask: DataFrame, grid: Grid) -> DataFrame:
    """axes and lbl for each foreground voxel."""
    local = written(spark, local_labels(mask, grid), "local-labels")
    edges = seam_edges(local, grid)
    joined = components(spark, edges).select(F.col("node").alias("lbl"), "comp")
    return local.join(joined, "lbl", "left").select(*grid.axes, F.coalesce("comp", "lbl").alias("lbl"))


def label_counts(local: DataFrame, grid: Grid) -> DataFrame:
    """Labels in each chunk, and the offset that would number them over all chunks."""
    counts = local.groupBy(*grid.keys).agg(F.countDistinct("lbl").alias("n"))
    return exclusive_offsets(counts, grid.keys)


def dense_ids(labels: DataFrame, column: str = "lbl") -> DataFrame:
    """Distinct labels and their ranks from 1, numbered range by range without one ordered pass over all.

    Labels are ranked within ranges that together cover their order; only one row for each range is
    summed in order.
    """
    from pyspark.sql import Window

    distinct = labels.select(column).distinct()
    span = distinct.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if span.low is None:
        return distinct.withColumn("dense", F.lit(None).cast("long"))
    width = max(1, -(-(span.high - span.low + 1) // 1000))
    ranged = distinct.withColumn("__range", F.floor((F.col(column) - span.low) / width))
    counts = exclusive_offsets(ranged.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__one", F.lit(0)), ("__range", "__one"))
    within = Window.partitionBy("__range").orderBy(column)
    return ranged.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(counts.select("__range", "offset")), "__range").select(column, (F.col("offset") + F.col("__rank")).alias("dense"))


def with_ids(voxels: DataFrame, grid: Grid) -> DataFrame:
    return voxels.withColumn("id", linear_id([F.col(a) for a in grid.axes], grid.shape))
