"""Column expressions over voxels and objects; all run inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intercept, coefficient of the distance, largest divisor.
BORDER = (3.0, -0.5, 2.0)


def clipped(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def to_uint8(v: Column, max_value: float) -> Column:
    """Scaled to 0..255, truncated."""
    return F.floor(clipped(v / F.lit(float(max_value)), 0, 1) * 255).cast("int")


def bias_corrected(v: Column, bias: Column) -> Column:
    """v over bias, clipped to sixteen unsigned bits and truncated; null where the bias is 0."""
    return F.floor(clipped(F.try_divide(v.cast("double"), bias), 0, 65535)).cast("int")


def half_rounded(v: Column) -> Column:
    """v rounded to the nearest half-precision number (ties to even), as a double; no overflow to infinity."""
    exponent = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14))
    step = F.pow(F.lit(2.0), exponent - 10)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.rint(v / step) * step)


def above(v: Column, threshold: float) -> Column:
    return v.cast("double") > F.lit(float(threshold))


def xor(a: Column, b: Column) -> Column:
    """Whether exactly one of two conditions holds."""
    return a != b


def masked(v: Column, threshold: float) -> Column:
    """v where it exceeds the threshold, else 0."""
    return F.when(above(v, threshold), v.cast("double")).otherwise(F.lit(0.0))


def log_density(n: Column) -> Column:
    return F.log2(n + 1)


def block_of(coordinate: Column, size: int) -> Column:
    return F.floor(coordinate / size).cast("int")


def border_weight(centre: list[Column], extent: list[int | Column], params: tuple[float, float, float] = BORDER) -> Column:
    """How much of an object at a chunk's border counts: over all axes, the product of one over the clipped line.

    The distance to the nearer of the two borders is measured from voxel edges.
    """
    intercept, slope, most = params

    def axis(c: Column, n: int | Column) -> Column:
        half = (n if isinstance(n, Column) else F.lit(n)) / F.lit(2.0)
        whole = 2 * half
        distance = F.abs(F.pmod(c + half, whole) - (half - 0.5))
        return 1 / clipped(intercept + distance * slope, 1, most)

    return reduce(lambda a, b: a * b, [axis(c, n) for c, n in zip(centre, extent, strict=True)])


def cells_by_size(nvoxel: Column, on_edge: Column, weight: Column, min_size: int = 0, size_threshold: float = 25, volume_weight: float = 6e-3) -> Column:
    """Estimated cells of one object: one, less at a border, more beyond the size threshold."""
    base = F.when(on_edge, weight).otherwise(F.lit(1.0))
    more = F.when(nvoxel > size_threshold, (nvoxel - size_threshold) * volume_weight).otherwise(F.lit(0.0))
    return F.when(nvoxel <= min_size, F.lit(0.0)).otherwise(base + more)


def gather_index(row: list[float], offset: float, out: list[Column]) -> Column:
    """The input index along one axis that an output voxel's centre falls on."""
    terms = [F.lit(float(m)) * (c + 0.5) for m, c in zip(row, out, strict=True)]
    return F.floor(reduce(lambda a, b: a + b, terms) + F.lit(float(offset))).cast("long")


def linear_id(axes: list[Column], shape: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for c, n in zip(axes, shape, strict=True):
        out = out * n + c
    return out
