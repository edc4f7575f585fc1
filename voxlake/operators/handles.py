"""A volume with its grid in one handle, for code that passes volumes about."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.blocks import Grid, block_sum


@dataclass(frozen=True)
class BlockArray:
    """Voxels (axes and value columns) and the grid they are cut by; always lazy."""

    df: DataFrame
    grid: Grid
    value: str = "v"

    def __post_init__(self) -> None:
        if missing := {*self.grid.axes, self.value} - set(self.df.columns):
            raise ValueError(f"no columns {sorted(missing)}")

    #: Voxels never lie in one piece in the driver, and how they are kept is one thing only.
    is_numpy = False
    repr_format = "blocks of voxels"

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)[self.value]

    @property
    def ndim(self) -> int:
        return self.grid.ndim

    @property
    def numblocks(self) -> tuple[int, ...]:
        return self.grid.numblocks

    @property
    def chunksize(self) -> tuple[int, ...]:
        return self.grid.chunksize

    def block_indices(self) -> list[tuple[int, ...]]:
        return list(product(*map(range, self.numblocks)))

    def slices_list(self) -> list[tuple[slice, ...]]:
        spans = [[slice(s, e) for s, e in self.grid.bounds(k)] for k in range(self.ndim)]
        return list(product(*spans))

    def properties(self) -> dict:
        return {"repr_format": self.repr_format, "ndim": self.ndim, "numblocks": self.numblocks, "chunksize": self.chunksize, "is_numpy": self.is_numpy, "dtype": self.dtype}

    def frame(self) -> DataFrame:
        """The voxels as one relation without block keys."""
        return self.df.select(*self.grid.axes, self.value)

    def rechunked(self, chunks: tuple) -> BlockArray:
        """The same voxels under another cut; nothing moves until a block operator runs."""
        return replace(self, grid=Grid(self.grid.shape, chunks, self.grid.axes))

    def column(self, name: str) -> BlockArray:
        return replace(self, value=name)

    def total(self) -> DataFrame:
        """Sum of all voxels, through a sum for each block."""
        return block_sum(self.df, self.grid, self.value).agg(F.sum("total").alias("total"))

    def to_numpy(self, most: int = 1 << 24, fill: float = 0) -> np.ndarray:
        """The dense array in the driver, for a grid of at most most voxels."""
        if (size := int(np.prod(self.grid.shape))) > most:
            raise ValueError(f"{size} voxels are more than {most}")
        rows = self.frame().toPandas()
        out = np.full(self.grid.shape, fill, rows[self.value].dtype if len(rows) else float)
        out[tuple(rows[a].to_numpy() for a in self.grid.axes)] = rows[self.value].to_numpy()
        return out

    @classmethod
    def from_blocks(cls, spark: SparkSession, parts: dict[tuple[int, ...], np.ndarray], grid: Grid) -> BlockArray:
        """From one array for each block index; every block must be there and have its extent."""
        held = []
        for index in product(*map(range, grid.numblocks)):
            spans = [grid.bounds(k)[b] for k, b in enumerate(index)]
            part = np.asarray(parts[index])
            if part.shape != tuple(e - s for s, e in spans):
                raise ValueError(f"block {index} has shape {part.shape}")
            at = np.indices(part.shape).reshape(grid.ndim, -1)
            held.append(pd.DataFrame({**{a: c + s for a, c, (s, _) in zip(grid.axes, at, spans, strict=True)}, "v": part.ravel()}))
        return cls(spark.createDataFrame(pd.concat(held)), grid)


def map_all(frames: list[DataFrame], grid: Grid, fn: Callable[[tuple[int, ...], list[pd.DataFrame]], pd.DataFrame], schema: str, missing: str = "error") -> DataFrame:
    """fn(block, rows of each frame) for each block, over any number of frames.

    Frames are tagged and meet in one shuffle by block. A block that some frame lacks raises KeyError, is left
    out (missing="drop"), or gives that frame no rows (missing="empty").
    """
    if missing not in ("error", "drop", "empty"):
        raise ValueError(missing)
    columns = [[c for c in f.columns if c not in grid.axes] for f in frames]
    tagged = [grid.with_blocks(f.select(*grid.axes, *[F.col(c).alias(f"{c}__{k}") for c in own])).withColumn("__frame", F.lit(k)) for k, (f, own) in enumerate(zip(frames, columns, strict=True))]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = tuple(int(rows[k].iloc[0]) for k in grid.keys)
        parts = []
        for k, own in enumerate(columns):
            part = rows[rows["__frame"] == k]
            if missing != "empty" and part.empty:
                if missing == "error":
                    raise KeyError(f"frame {k} has no block {block}")
                return pd.DataFrame()
            parts.append(part[[*grid.axes, *[f"{c}__{k}" for c in own]]].rename(columns={f"{c}__{k}": c for c in own}).reset_index(drop=True))
        return fn(block, parts)

    return union.groupBy(*grid.keys).applyInPandas(run, schema)


def pad_to_multiple(volume: BlockArray, n: int, spark: SparkSession) -> BlockArray:
    """The volume with zeros after it, so that every axis is a multiple of n long."""
    shape = tuple(-(-s // n) * n for s in volume.grid.shape)
    out = volume.frame()
    for k, (axis, old, new) in enumerate(zip(volume.grid.axes, volume.grid.shape, shape, strict=True)):
        if new > old:  # a slab beyond axis k, as wide as the padded axes before it and the old ones after
            sides = [new - old if j == k else shape[j] if j < k else volume.grid.shape[j] for j in range(volume.ndim)]
            slab, stride = spark.range(int(np.prod(sides))), int(np.prod(sides))
            at = []
            for j, (a, side) in enumerate(zip(volume.grid.axes, sides, strict=True)):
                stride //= side
                at.append((F.expr(f"(id div {stride}) % {side}") + (old if j == k else 0)).alias(a))
            out = out.unionByName(slab.select(*at, F.lit(0).cast(volume.dtype).alias(volume.value)))
    chunks = tuple(c if isinstance(c, int) else (*c, *([new - old] if new > old else [])) for c, old, new in zip(volume.grid.chunks, volume.grid.shape, shape, strict=True))
    return BlockArray(out, Grid(shape, chunks, volume.grid.axes), volume.value)
