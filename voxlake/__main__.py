"""Command line: python -m voxlake dice A B [--level N] compares two masks; B's voxels over 0 are the reference."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.evaluation import dice
from voxlake.session import get_session
from voxlake.sources import arrays, ome


def mask_of(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Coordinates of the voxels over 0 of an image folder, a NumPy file, or numbered slices (a pattern ending in .png)."""
    if path.endswith(".npy"):
        df = arrays.read_npy(spark, path)
    elif path.endswith(".png"):
        df = arrays.recover_volumes(spark, path)
    else:
        df = ome.read_image(spark, path, level, sparse=True)
    return df.where(F.col("v") > 0).select("z", "y", "x")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> float | None:
    parser = argparse.ArgumentParser(prog="voxlake")
    commands = parser.add_subparsers(dest="command", required=True)
    compare = commands.add_parser("dice", help="twice the common foreground over the sum of both")
    compare.add_argument("a")
    compare.add_argument("b")
    compare.add_argument("--level", type=int, default=0, help="pyramid level of image folders")
    given = parser.parse_args(arguments)
    spark = spark or get_session()
    found = dice(mask_of(spark, given.a, given.level), mask_of(spark, given.b, given.level)).first().dice
    print(found)
    return found


if __name__ == "__main__":
    main()
