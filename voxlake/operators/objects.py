"""From labelled voxels to objects: centroids, boxes, sizes, and estimated counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.voxel import BORDER, border_weight, cells_by_size
from voxlake.operators.blocks import Grid


def objects_by_block(labels: DataFrame, grid: Grid, min_size: int = 0) -> DataFrame:
    """One row for each label and block: centroid, nvoxel, edge_contact (touches the block's border)."""
    means = [F.avg(a).alias(f"c{a}") for a in grid.axes]
    found = grid.with_blocks(labels).withColumn("__edge", grid.on_border()).groupBy(*grid.keys, "lbl").agg(*means, F.count("*").alias("nvoxel"), F.max("__edge").alias("edge_contact"))
    return found.where(F.col("nvoxel") > min_size)


def objects_global(labels: DataFrame, grid: Grid, min_size: int = 0, by_fragment: bool = False) -> DataFrame:
    """One row for each label over the whole volume; edge_contact is with the volume's border.

    The owner block is the one that holds the centroid. With by_fragment, min_size drops the parts of
    an object that are small within their block before they are merged.
    """
    sums = [F.sum(F.col(a).cast("double")).alias(f"s{a}") for a in grid.axes]
    touch = [(F.col(a) == 0) | (F.col(a) == n - 1) for a, n in zip(grid.axes, grid.shape, strict=True)]
    edge = touch[0]
    for t in touch[1:]:
        edge = edge | t
    keys = [*grid.keys, "lbl"] if by_fragment else ["lbl"]
    rows = (grid.with_blocks(labels) if by_fragment else labels).withColumn("__edge", edge)
    found = rows.groupBy(*keys).agg(*sums, F.count("*").alias("nvoxel"), F.max("__edge").alias("edge_contact"))
    if by_fragment:
        found = found.where(F.col("nvoxel") > min_size).groupBy("lbl").agg(*[F.sum(f"s{a}").alias(f"s{a}") for a in grid.axes], F.sum("nvoxel").alias("nvoxel"), F.max("edge_contact").alias("edge_contact"))
    else:
        found = found.where(F.col("nvoxel") > min_size)
    centred = found.withColumns({f"c{a}": F.col(f"s{a}") / F.col("nvoxel") for a in grid.axes})
    owners = {key: grid.block(k, F.col(f"c{a}")) for k, (key, a) in enumerate(zip(grid.keys, grid.axes, strict=True))}
    return centred.withColumns(owners).select(*grid.keys, "lbl", *[f"c{a}" for a in grid.axes], "nvoxel", "edge_contact")


def bounding_boxes(labels: DataFrame, grid: Grid) -> DataFrame:
    """Half-open extent of each label along each axis."""
    low = [F.min(a).alias(f"{a}0") for a in grid.axes]
    high = [(F.max(a) + 1).alias(f"{a}1") for a in grid.axes]
    return labels.groupBy("lbl").agg(*low, *high)


def voxel_lists(labels: DataFrame, grid: Grid) -> DataFrame:
    """Each label's voxels in scan order; for objects known to be small."""
    return labels.groupBy("lbl").agg(F.sort_array(F.collect_list(F.struct(*grid.axes))).alias("voxels"))


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("lbl").agg(F.count("*").alias("nvoxel"))


def split_by_size(labels: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Voxels of objects under the threshold, and of the others."""
    sized = labels.join(label_sizes(labels), "lbl")
    return sized.where(F.col("nvoxel") < threshold).drop("nvoxel"), sized.where(F.col("nvoxel") >= threshold).drop("nvoxel")


def count_edge_penalized(objects: DataFrame, grid: Grid, params: tuple[float, float, float] = BORDER) -> DataFrame:
    """ncells of each object by its distance to the border of its own block."""
    local = [F.col(f"c{a}") - grid.start(k) for k, a in enumerate(grid.axes)]
    extent = [grid.stop(k) - grid.start(k) for k in range(grid.ndim)]
    return objects.withColumn("ncells", border_weight(local, extent, params))


def count_by_size(objects: DataFrame, grid: Grid, min_size: int = 0, size_threshold: float = 25, volume_weight: float = 6e-3, params: tuple[float, float, float] = BORDER, always_penalize: bool = False) -> DataFrame:
    """ncells of each object by its size, less at the volume's border."""
    weight = border_weight([F.col(f"c{a}") for a in grid.axes], list(grid.shape), params)
    edge = F.lit(True) if always_penalize else F.col("edge_contact")
    return objects.withColumn("ncells", cells_by_size(F.col("nvoxel"), edge, weight, min_size, size_threshold, volume_weight))
