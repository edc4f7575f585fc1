"""Resampling by nearest voxel, nearest seed, and splitting by seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.voxel import clipped, gather_index
from voxlake.sources.volumes import AXES, coordinates
from voxlake.storage import written

#: Most seeds that are sent to every task in one piece.
SEEDS_AT_ONCE = 20_000


def affine_nearest(spark: SparkSession, df: DataFrame, matrix: list[list[float]], offset: list[float], in_shape: tuple[int, ...], out_shape: tuple[int, ...], axes: tuple[str, ...] = AXES, cval: float | None = None, value: str = "v") -> DataFrame:
    """A dense output whose voxel o has the value of input voxel floor(M (o + 1/2) + offset).

    Outside the input the nearest border voxel counts or, with cval, that constant. The output side
    computes its key by arithmetic; the equi-join to the input is left to the optimizer.
    """
    out = coordinates(spark, out_shape, tuple(f"o{a}" for a in axes))
    ocols = [F.col(f"o{a}") for a in axes]
    inside = F.lit(True)
    keys: dict[str, Column] = {}
    for axis, row, shift, n in zip(axes, matrix, offset, in_shape, strict=True):
        at = gather_index(row, shift, ocols)
        inside = inside & (at >= 0) & (at < n)
        keys[axis] = clipped(at, 0, n - 1).cast("long")
    placed = out.withColumns(keys | {"__in": inside})
    got = placed.join(df.select(*axes, value), list(axes), "left")
    v = F.col(value) if cval is None else F.when(F.col("__in"), F.col(value)).otherwise(F.lit(cval))
    return got.select(*[F.col(f"o{a}").alias(a) for a in axes], v.alias(value))


def scale_nearest(spark: SparkSession, df: DataFrame, scale: tuple[float, ...] | float, in_shape: tuple[int, ...], out_shape: tuple[int, ...] | None = None, axes: tuple[str, ...] = AXES, cval: float | None = None) -> DataFrame:
    scale = (scale,) * len(axes) if isinstance(scale, (int, float)) else scale
    out_shape = out_shape or tuple(int(n * s) for n, s in zip(in_shape, scale, strict=True))
    matrix = [[(1 / s if i == j else 0.0) for j in range(len(axes))] for i, s in enumerate(scale)]
    return affine_nearest(spark, df, matrix, [0.0] * len(axes), in_shape, out_shape, axes, cval)


def _distance2(axes: tuple[str, ...], prefix: str) -> Column:
    out = F.lit(0.0)
    for a in axes:
        d = F.col(a).cast("double") - F.col(f"{prefix}{a}")
        out = out + d * d
    return out


def nearest_seed(spark: SparkSession, points: DataFrame, seeds: DataFrame, axes: tuple[str, ...] = AXES, seed: str = "seed", cell: float | None = None) -> DataFrame:
    """points with the index of the nearest seed; of equally near ones the smallest, without any seed null.

    Up to SEEDS_AT_ONCE seeds travel in one array beside the points, and each point takes the minimum over
    it. With more, or with cell, each place meets the seeds of its own and the neighbouring cells; one
    nearer than a cell's edge is proven, and places without goes on with cells of twice the edge. Any cell
    gives the same result; one near the usual distance to a seed gives it in a round or two.
    """
    if cell is None:
        n = seeds.count()
        if n <= SEEDS_AT_ONCE:
            every = seeds.agg(F.collect_list(F.struct(seed, *[F.col(a).cast("double").alias(a) for a in axes])).alias("__seeds"))

            def d2(s: Column) -> Column:
                total = F.lit(0.0)
                for a in axes:
                    total = total + (F.col(a).cast("double") - s[a]) * (F.col(a).cast("double") - s[a])
                return total

            best = F.array_min(F.transform("__seeds", lambda s: F.struct(d2(s).alias("d2"), s[seed].alias("seed"))))
            return points.join(F.broadcast(every)).withColumn(seed, best["seed"]).drop("__seeds")
    ends = [f(a).cast("double").alias(f"{k}{a}") for k, f in (("low", F.min), ("high", F.max)) for a in axes]
    spans = [df.agg(*ends).first() for df in (seeds, points)]
    if any(r[0] is None for r in spans):
        return points.withColumn(seed, F.lit(None).cast(dict(seeds.dtypes)[seed]))
    extent = max(max(r[f"high{a}"] for r in spans) - min(r[f"low{a}"] for r in spans) for a in axes) + 1
    cell = float(cell) if cell else max(1.0, extent / n ** (1 / len(axes)))
    left, proven = points.select(*axes).distinct(), None
    while left is not None:
        found = written(spark, _met(left, seeds, axes, seed, cell), "nearest")
        sure = F.lit(True) if cell > extent else F.coalesce(F.col("d2") < cell * cell, F.lit(False))
        near = found.where(sure).select(*axes, "__seed")
        proven = near if proven is None else proven.unionAll(near)
        left = found.where(~sure).select(*axes)
        cell, left = 2 * cell, None if left.isEmpty() else left
    return points.join(proven.withColumnRenamed("__seed", seed), list(axes), "left").select(*points.columns, seed)


def _met(places: DataFrame, seeds: DataFrame, axes: tuple[str, ...], seed: str, cell: float) -> DataFrame:
    """For each place the nearest seed of its own and the neighbouring cells: axes, d2, __seed; null where these have none."""
    home = [F.floor(F.col(a) / cell).alias(f"__h{a}") for a in axes]
    spread = seeds.select(F.col(seed).alias("__seed"), *[F.col(a).cast("double").alias(f"s{a}") for a in axes])
    for a in axes:
        spread = spread.withColumn(f"__h{a}", F.explode(F.array(*[F.floor(F.col(f"s{a}") / cell) + k for k in (-1, 0, 1)])))
    met = places.select("*", *home).join(spread, [f"__h{a}" for a in axes], "left")
    nearest = F.min(F.when(F.col("__seed").isNotNull(), F.struct(_distance2(axes, "s").alias("d2"), F.col("__seed").alias("s"))))
    return met.groupBy(*axes).agg(nearest.alias("b")).select(*axes, F.col("b.d2").alias("d2"), F.col("b.s").alias("__seed"))


def split_by_seeds(labels: DataFrame, seeds: DataFrame, axes: tuple[str, ...] = AXES, most: int = 10) -> DataFrame:
    """Labels with part: objects that hold 2 to most seeds are divided by nearest seed; part is the seed's rank.

    seeds (seed, axes) are floored to voxels; those in background are discarded. Part 0 is the first
    seed's share, and the whole of an object that is not divided.
    """
    at = seeds.select("seed", *[F.floor(F.col(a)).cast("long").alias(a) for a in axes])
    inside = at.join(labels, list(axes)).select("lbl", F.struct("seed", *axes).alias("s"))
    several = inside.groupBy("lbl").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("s")).alias("seeds")).where((F.col("n") >= 2) & (F.col("n") <= most))

    def ranked(s: Column, k: Column) -> Column:
        d2 = F.lit(0.0)
        for a in axes:
            d = (F.col(a) - s[a]).cast("double")
            d2 = d2 + d * d
        return F.struct(d2.alias("d2"), k.alias("k"))

    joined = labels.join(several.select("lbl", "seeds"), "lbl", "left")
    nearest = F.array_min(F.transform("seeds", ranked))["k"]
    return joined.select(*axes, "lbl", F.coalesce(nearest, F.lit(0)).cast("int").alias("part"))
