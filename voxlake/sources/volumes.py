"""Volumes as relations of voxels: coordinate columns and a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.session import read_table

AXES = ("z", "y", "x")
#: Rows and columns of the plane that one embedding becomes.
PLANE = (8, 8)


def embedding_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, v: each embedding is one plane of eight by eight voxels."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "f"))
    width = PLANE[1]
    return rows.select(
        F.col("vec_id").alias("z"),
        F.expr(f"cast(p div {width} as bigint)").alias("y"),
        F.expr(f"cast(p % {width} as bigint)").alias("x"),
        F.col("f").cast("double").alias("v"),
    )


def volume_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """From the table's own statistics: one aggregate over one column."""
    depth = read_table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return (0 if depth is None else depth + 1, *PLANE)


def event_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = user, x = hour since the first of January 2024, v = sum of values; sparse."""
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    return read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("y"), hour.alias("x")).agg(F.sum("value").alias("v"))


def coordinates(spark: SparkSession, shape: tuple[int, ...], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Every coordinate of a dense grid, by arithmetic on a range."""
    size = 1
    for n in shape:
        size *= n
    df, stride = spark.range(size), size
    columns = []
    for axis, n in zip(axes, shape, strict=True):
        stride //= max(1, n)
        columns.append(F.expr(f"(id div {stride}) % {n}").alias(axis))
    return df.select(*columns)


def coord_map(spark: SparkSession, shape: tuple[int, ...], value: Callable[..., Column], axes: tuple[str, ...] = AXES) -> DataFrame:
    """A dense volume whose values are a function of the coordinate columns."""
    return coordinates(spark, shape, axes).withColumn("v", value(*[F.col(a) for a in axes]))


def synthetic_balls(spark: SparkSession, shape: tuple[int, int, int, int]) -> DataFrame:
    """c, z, y, x, v: bright balls on a lattice of 32 voxels that fade with distance from the origin."""

    def value(_c: Column, *space: Column) -> Column:
        fall = sum(((a % 32 - 15.5) * (a % 32 - 15.5) + 0.0002 * a * a for a in space), F.lit(0.0))
        return F.floor(F.least(F.greatest(1200 - 15 * fall, F.lit(0.0)), F.lit(1200.0))).cast("int")

    return coord_map(spark, shape, value, ("c", *AXES))


def checkerboard(spark: SparkSession, shape: tuple[int, ...], chunks: tuple[int, ...], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Parity of the block index at every voxel."""

    def value(*cs: Column) -> Column:
        return (sum((F.floor(c / n) for c, n in zip(cs, chunks, strict=True)), F.lit(0)) % 2).cast("int")

    return coord_map(spark, shape, value, axes)


def normalised_pair(image: DataFrame, labels: DataFrame, max_value: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Image scaled to 0..255 and the binary label of each voxel."""
    u8 = F.floor(F.least(F.greatest(F.col("v") / max_value, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    seg = labels.select(*axes, (F.col("v") > 0).cast("int").alias("seg"))
    return image.select(*axes, u8.alias("im")).join(seg, list(axes), "left").withColumn("seg", F.coalesce("seg", F.lit(0)))
