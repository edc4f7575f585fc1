"""Chunk grids: which block owns a voxel, what a block spans, and kernels over blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = ("bz", "by", "bx")


@dataclass(frozen=True)
class Grid:
    """A volume's extent and how it is cut; an axis is cut evenly or at listed sizes."""

    shape: tuple[int, ...]
    chunks: tuple[int | tuple[int, ...], ...]
    axes: tuple[str, ...] = ("z", "y", "x")

    def __post_init__(self) -> None:
        if not len(self.shape) == len(self.chunks) == len(self.axes):
            raise ValueError("shape, chunks and axes differ in length")
        for n, c in zip(self.shape, self.chunks, strict=True):
            if not isinstance(c, int) and sum(c) != n:
                raise ValueError(f"chunks {c} do not fill {n}")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(f"b{a}" for a in self.axes)

    def bounds(self, k: int) -> list[tuple[int, int]]:
        """Half-open spans of the blocks along axis k."""
        n, c = self.shape[k], self.chunks[k]
        sizes = c if not isinstance(c, int) else [min(c, n - s) for s in range(0, n, c)]
        ends = list(accumulate(sizes))
        return list(zip([0, *ends[:-1]], ends, strict=True))

    @property
    def numblocks(self) -> tuple[int, ...]:
        return tuple(len(self.bounds(k)) for k in range(self.ndim))

    @property
    def chunksize(self) -> tuple[int, ...]:
        """Extent of the first block."""
        return tuple(self.bounds(k)[0][1] for k in range(self.ndim))

    def block(self, k: int, c: Column | None = None) -> Column:
        """The block along axis k that holds a coordinate (whole or fractional)."""
        c = F.col(self.axes[k]) if c is None else c
        if isinstance(self.chunks[k], int):
            return F.floor(c / self.chunks[k]).cast("int")
        ends = F.array(*[F.lit(float(e)) for _, e in self.bounds(k)[:-1]])
        return F.size(F.filter(ends, lambda e: c >= e))

    def _span(self, k: int, at: int) -> Column:
        b = F.col(self.keys[k]) if at == 0 else F.col(self.keys[k]) + 1
        if isinstance(self.chunks[k], int):
            return F.least(b * self.chunks[k], F.lit(self.shape[k])).cast("long")
        edges = F.array(*[F.lit(e).cast("long") for e in (0, *[e for _, e in self.bounds(k)])])
        return F.get(edges, b)

    def start(self, k: int) -> Column:
        return self._span(k, 0)

    def stop(self, k: int) -> Column:
        return self._span(k, 1)

    def with_blocks(self, df: DataFrame) -> DataFrame:
        return df.withColumns({key: self.block(k) for k, key in enumerate(self.keys)})

    def on_border(self) -> Column:
        """Whether a voxel is a first or last one of its block along any axis."""
        touches = [(F.col(a) == self.start(k)) | (F.col(a) == self.stop(k) - 1) for k, a in enumerate(self.axes)]
        out = touches[0]
        for t in touches[1:]:
            out = out | t
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each block along each axis: axis, b, start, stop."""
        rows = [(k, b, s, e) for k in range(self.ndim) for b, (s, e) in enumerate(self.bounds(k))]
        return spark.createDataFrame(rows, "axis int, b int, start long, stop long")


def map_blocks(df: DataFrame, grid: Grid, fn: Callable, schema: str | StructType) -> DataFrame:
    """fn(key, rows as pandas) for each block that has rows; it returns rows of any number."""
    return grid.with_blocks(df).groupBy(*grid.keys).applyInPandas(fn, schema)


def zip_blocks(left: DataFrame, right: DataFrame, grid: Grid, fn: Callable, schema: str | StructType) -> DataFrame:
    """fn(key, left rows, right rows) for each block that either has."""
    a, b = grid.with_blocks(left).groupBy(*grid.keys), grid.with_blocks(right).groupBy(*grid.keys)
    return a.cogroup(b).applyInPandas(fn, schema)


def block_sum(df: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    return grid.with_blocks(df).groupBy(*grid.keys).agg(F.sum(value).alias("total"))


def block_totals(cells: DataFrame, grid: Grid, value: str = "ncells") -> DataFrame:
    """Sum of a count per block, at the block's midpoint (half a voxel beyond its centre)."""
    mid = [(F.col(f"s{a}") + (F.col(f"e{a}") - F.col(f"s{a}") + 1) / 2).alias(f"c{a}") for a in grid.axes]
    totals = cells.groupBy(*grid.keys).agg(F.sum(value).alias(value))
    spans = {f"s{a}": grid.start(k) for k, a in enumerate(grid.axes)} | {f"e{a}": grid.stop(k) for k, a in enumerate(grid.axes)}
    return totals.withColumns(spans).select(*grid.keys, *mid, value)


def exclusive_offsets(counts: DataFrame, keys: tuple[str, ...], value: str = "n") -> DataFrame:
    """Running sum of the blocks before each block, in block order.

    Blocks are first summed along all but the first key, so that the one ordered pass runs over the
    first axis' blocks alone; each slab then has its own running sum.
    """
    from pyspark.sql import Window

    first, rest = keys[0], keys[1:]
    slabs = counts.groupBy(first).agg(F.sum(value).alias("__slab"))
    before = slabs.select(first, F.coalesce(F.sum("__slab").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy(first).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(before, first).select(*keys, value, (F.col("__before") + F.col("__in")).cast("long").alias("offset"))
