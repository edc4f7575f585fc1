"""Neighbourhood kernels that run within a block: distance transform, watershed, blobs, spline prefilter.

A block becomes a dense array, bounded by the chunk size; results are rows again. Labels are local
to a block, as these stages define them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.blocks import Grid, map_blocks
from voxlake.operators.labels import label_points


def _axis_envelope(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)**2 along the last axis; the axis is one side of a chunk."""
    n = f.shape[-1]
    i = np.arange(n)
    cost = (i[:, None] - i[None, :]) ** 2
    out = np.full(f.shape, np.inf)
    for j in range(n):
        np.minimum(out, f[..., j : j + 1] + cost[j], out=out)
    return out


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of foreground voxels to the nearest background voxel; without any, infinite."""
    f = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        f = np.moveaxis(_axis_envelope(np.moveaxis(f, axis, -1)), -1, axis)
    return np.sqrt(f)


def label_dense(mask: np.ndarray) -> np.ndarray:
    """Components in scan order of their first voxel, from 1; 0 is background."""
    out = np.zeros(mask.shape, np.int64)
    points = np.argwhere(mask)
    if len(points):
        out[mask] = np.unique(label_points(points, mask.shape), return_inverse=True)[1] + 1
    return out


def flood(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Markers grown over the mask in order of height, then of arrival; faces connect."""
    out = np.where(mask, markers, 0)
    queue: list[tuple[float, int, tuple[int, ...]]] = []
    turn = 0
    for p in map(tuple, np.argwhere(out > 0)):
        heapq.heappush(queue, (height[p], turn, p))
        turn += 1
    while queue:
        _, _, p = heapq.heappop(queue)
        for axis in range(mask.ndim):
            for d in (-1, 1):
                q = (*p[:axis], p[axis] + d, *p[axis + 1 :])
                if 0 <= q[axis] < mask.shape[axis] and mask[q] and not out[q]:
                    out[q] = out[p]
                    heapq.heappush(queue, (height[q], turn, q))
                    turn += 1
    return out


def watershed(mask: np.ndarray, seed_distance: float = 1.0, least: float | None = None) -> np.ndarray:
    """Objects grown from the voxels at least seed_distance deep, numbered by their seeds in scan order.

    With least, objects of fewer voxels lose their seeds, and the others grow over them. Foreground that no
    object reaches, as it holds no seed or only lost ones, becomes objects of its own, numbered after the rest,
    so the foreground stays whole.
    """
    if not mask.any():
        return np.zeros(mask.shape, np.int64)
    depth = np.minimum(distance_transform(mask), float(sum(mask.shape)))
    seeds = label_dense(mask & (depth >= seed_distance))
    grown = flood(-depth, seeds, mask)
    if least is not None:
        weak = np.flatnonzero(np.bincount(grown.ravel()) < least)
        if len(weak := weak[weak > 0]):
            grown = flood(-depth, np.where(np.isin(grown, weak), 0, seeds), mask)
    missed = label_dense(mask & (grown == 0))
    grown[missed > 0] = missed[missed > 0] + grown.max()
    return grown


def watershed_3sizes(mask: np.ndarray, size1: float = 60, distance1: float = 1.0, least1: float | None = None, size2: float = 100, distance2: float = 1.5, least2: float | None = 60) -> np.ndarray:
    """Components under size1 stay whole, those under size2 are split at one depth and larger ones at another.

    Ids are dense from 1: first the objects of the middle components, then the small components, then the
    objects of the large ones, each in the order that their own step gives.
    """
    components = label_dense(mask)
    extent = np.bincount(components.ravel(), minlength=1)[components]
    middle, large = mask & (extent >= size1) & (extent < size2), mask & (extent >= size2)
    order = np.select([middle, large], [0, 2], 1)
    own = np.select([middle, large], [watershed(middle, distance1, least1), watershed(large, distance2, least2)], components)
    out = np.zeros(mask.shape, np.int64)
    if mask.any():
        out[mask] = np.unique(np.stack([order[mask], own[mask]]), axis=1, return_inverse=True)[1].ravel() + 1
    return out


def gaussian(a: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Separable smoothing; borders are mirrored with the edge voxel repeated."""
    r = int(reach * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in range(a.ndim):
        n = a.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)
        padded = np.take(a, np.where(at >= n, 2 * n - 1 - at, at), axis)
        a = sum(w * np.take(padded, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return a


def blobs_dog(block: np.ndarray, min_sigma: float = 1.0, max_sigma: float = 2.0, threshold: float = 0.1, ratio: float = 1.6, overlap: float = 0.5) -> np.ndarray:
    """Rows of coordinates and sigma: peaks over space and scale of differences of Gaussians of the block in 0..255.

    Of two blobs whose spheres overlap by more than the given share of the smaller, the smaller sigma goes.
    """
    image = np.clip(np.floor(block * 255), 0, 255) / 255
    steps = int(math.log(max_sigma / min_sigma, ratio) + 1)
    sigmas = [min_sigma * ratio**i for i in range(steps + 1)]
    smooth = [gaussian(image, s) for s in sigmas]
    cube = np.stack([(a - b) * (1 / (ratio - 1)) for a, b in zip(smooth[:-1], smooth[1:], strict=True)], -1)
    padded = np.pad(cube, 1, constant_values=-np.inf)
    top = np.ones(cube.shape, bool)
    for shift in np.ndindex(*(3,) * cube.ndim):
        top &= cube >= padded[tuple(slice(s, s + n) for s, n in zip(shift, cube.shape, strict=True))]
    found = np.argwhere(top & (cube > threshold))
    rows = [(*p[:-1].astype(float), sigmas[p[-1]]) for p in found]
    rows.sort(key=lambda r: (-r[-1], r))
    kept: list[tuple[float, ...]] = []
    for r in rows:
        if all(_shared_share(r, k) <= overlap for k in kept):
            kept.append(r)
    return np.array(sorted(kept)).reshape(-1, block.ndim + 1)


def _shared_share(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Common volume of two spheres over the smaller's; radii are sigma times the root of the dimension."""
    n = len(a) - 1
    r1, r2 = a[-1] * math.sqrt(n), b[-1] * math.sqrt(n)
    d = math.dist(a[:-1], b[:-1])
    if d >= r1 + r2:
        return 0.0
    small = min(r1, r2)
    if d <= abs(r1 - r2):
        return 1.0
    common = math.pi * (r1 + r2 - d) ** 2 * (d * d + 2 * d * (r1 + r2) - 3 * (r1 - r2) ** 2) / (12 * d)
    return common / (4 / 3 * math.pi * small**3)


#: Poles of the B-spline prefilter by order.
SPLINE_POLES = {2: (math.sqrt(8) - 3,), 3: (math.sqrt(3) - 2,)}


def spline_depth(order: int, tolerance: float = 1e-8) -> int:
    """Voxels after which the filter's answer falls below the tolerance."""
    if order < 2:
        return 0
    return max(math.ceil(math.log(tolerance) / math.log(abs(p))) for p in SPLINE_POLES[order])


def spline_prefilter(a: np.ndarray, order: int = 3) -> np.ndarray:
    """B-spline coefficients along every axis, mirrored at the borders (the edge voxel is not repeated)."""
    if order < 2:
        return a.astype(float)
    out = a.astype(float)
    for axis in range(a.ndim):
        n = a.shape[axis]
        if n == 1:
            continue
        c = np.moveaxis(out, axis, 0).copy()
        for z in SPLINE_POLES[order]:
            c *= (1 - z) * (1 - 1 / z)
            at = np.arange(2 * n - 2)
            mirrored = c[np.where(at < n, at, 2 * n - 2 - at)]
            powers = (z ** at.astype(float)).reshape(-1, *[1] * (c.ndim - 1))
            c[0] = (mirrored * powers).sum(0) / (1 - z ** (2 * n - 2))
            for i in range(1, n):
                c[i] += z * c[i - 1]
            c[-1] = z / (z * z - 1) * (z * c[-2] + c[-1])
            for i in range(n - 2, -1, -1):
                c[i] = z * (c[i + 1] - c[i])
        out = np.moveaxis(c, 0, axis)
    return out


def _dense(rows: pd.DataFrame, grid: Grid, key: tuple, value: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The block as an array, and its start."""
    bounds = [grid.bounds(k)[b] for k, b in enumerate(key)]
    start = np.array([s for s, _ in bounds])
    out = np.zeros([e - s for s, e in bounds], bool if value is None else float)
    at = tuple((rows[list(grid.axes)].to_numpy() - start).T)
    out[at] = True if value is None else rows[value].to_numpy()
    return out, start


def _key(rows: pd.DataFrame, grid: Grid) -> tuple[int, ...]:
    return tuple(int(rows[k].iloc[0]) for k in grid.keys)


def _fields(grid: Grid, more: str, coordinate: str = "long") -> str:
    return ", ".join([f"{k} int" for k in grid.keys] + [f"{a} {coordinate}" for a in grid.axes] + [more])


def _rows(grid: Grid, key: tuple, coordinates: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**{k: b for k, b in zip(grid.keys, key, strict=True)}, **dict(zip(grid.axes, coordinates.T, strict=True)), **values}, index=range(len(coordinates)))


def edt_by_block(mask: DataFrame, grid: Grid) -> DataFrame:
    """Distance of each foreground voxel to background within its block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = _key(rows, grid)
        dense, start = _dense(rows, grid, key, None)
        at = np.argwhere(dense)
        return _rows(grid, key, at + start, distance=distance_transform(dense)[dense])

    return map_blocks(mask, grid, run, _fields(grid, "distance double"))


def watershed_by_block(mask: DataFrame, grid: Grid, **sizes: float) -> DataFrame:
    """Labels within each block after the three-size split."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = _key(rows, grid)
        dense, start = _dense(rows, grid, key, None)
        at = np.argwhere(dense)
        return _rows(grid, key, at + start, lbl=watershed_3sizes(dense, **sizes)[dense])

    return map_blocks(mask, grid, run, _fields(grid, "lbl long"))


def blobs_by_block(df: DataFrame, grid: Grid, value: str = "v", **options: float) -> DataFrame:
    """Blob centres and sigma of each block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = _key(rows, grid)
        dense, start = _dense(rows, grid, key, value)
        found = blobs_dog(dense, **options)
        return _rows(grid, key, found[:, :-1] + start, sigma=found[:, -1])

    return map_blocks(df, grid, run, _fields(grid, "sigma double", "double"))


def _holds(axis: str) -> Callable[[Column], Column]:
    return lambda span: (F.col(axis) >= span.s) & (F.col(axis) < span.e)


def spline_by_block(df: DataFrame, grid: Grid, order: int = 3, value: str = "v") -> DataFrame:
    """Spline coefficients with a halo, so that blocks join without seams.

    Each voxel also goes to the blocks whose halo holds it; the halo is as deep as the filter reaches.
    """
    depth = spline_depth(order)
    blocks = df.select(*grid.axes, value)
    for k, (axis, key) in enumerate(zip(grid.axes, grid.keys, strict=True)):
        near = [b for b, _ in enumerate(grid.bounds(k))]
        spans = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s - depth).alias("s"), F.lit(e + depth).alias("e")) for b, (s, e) in zip(near, grid.bounds(k), strict=True)])
        blocks = blocks.withColumn(key, F.explode(F.transform(F.filter(spans, _holds(axis)), lambda p: p.b)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = _key(rows, grid)
        low = [max(0, grid.bounds(k)[b][0] - depth) for k, b in enumerate(key)]
        high = [min(grid.shape[k], grid.bounds(k)[b][1] + depth) for k, b in enumerate(key)]
        dense = np.zeros([e - s for s, e in zip(low, high, strict=True)])
        dense[tuple((rows[list(grid.axes)].to_numpy() - low).T)] = rows[value].to_numpy()
        out = spline_prefilter(dense, order)
        inner = tuple(slice(grid.bounds(k)[b][0] - s, grid.bounds(k)[b][1] - s) for k, (b, s) in enumerate(zip(key, low, strict=True)))
        part = out[inner]
        at = np.argwhere(np.ones(part.shape, bool)) + [grid.bounds(k)[b][0] for k, b in enumerate(key)]
        return _rows(grid, key, at, v=part.ravel())

    return blocks.groupBy(*grid.keys).applyInPandas(run, _fields(grid, "v double"))
