"""Multi-resolution volumes as Parquet, partitioned by level and sorted by block, with JSON metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.operators.reduction import pyramid
from voxlake.sources.metadata import checked_axes, label_metadata, level_scales, multiscales
from voxlake.sources.paths import split_query, sliced
from voxlake.storage import Files, load_json, save_json

METADATA = "metadata.json"


def write_pyramid(spark: SparkSession, path: str, volume: DataFrame, shape: tuple[int, ...], levels: int = 0, axes: tuple[str, ...] = ("z", "y", "x"), labels: DataFrame | None = None, label_name: str = "label", codec: str = "zstd", name: str | None = None) -> None:
    """Replaces what is at path by levels 0 to levels of the volume (v), and of labels (lbl) as a sibling below labels/.

    Level 0 is computed and written once and read back for the others. Within a level rows are
    dealt and sorted by their first axes, so a read of a slice skips files and row groups by statistics.
    """
    files = Files(spark, path)
    files.make(clear=True)

    def write(df: DataFrame, target: str) -> None:
        flat = df.select(*axes, *[c for c in df.columns if c not in axes])
        flat.repartitionByRange(axes[0]).sortWithinPartitions(*axes).write.option("compression", codec).parquet(f"{target}/level=0")
        base = spark.read.parquet(f"{target}/level=0")
        if levels:
            coarse = pyramid(base, levels).where("level > 0")
            coarse.sortWithinPartitions("level", *axes).write.option("compression", codec).partitionBy("level").mode("append").parquet(target)

    write(volume, f"{path}/image")
    datasets = [{"path": f"level={k}", "coordinateTransformations": t} for k, t in enumerate(level_scales(len(axes), levels))]
    described = checked_axes(list(axes), len(axes))
    save_json(files, METADATA, multiscales(datasets, described, name) | {"shape": list(shape)})
    if labels is not None:
        write(labels, f"{path}/labels/{label_name}")
        save_json(Files(spark, f"{path}/labels/{label_name}"), f"_{METADATA}", multiscales(datasets, described, label_name) | label_metadata())


def read_metadata(spark: SparkSession, path: str) -> dict:
    return load_json(Files(spark, path), METADATA)


def stored_levels(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("level=")) for n in Files(spark, f"{path}/image").names() if n.startswith("level="))


def highest_level(spark: SparkSession, path: str) -> int:
    """The last level of the unbroken run from 0; -1 without a level 0."""
    levels = stored_levels(spark, path)
    last = -1
    while last + 1 in levels:
        last += 1
    return last


def read_level(spark: SparkSession, path: str, level: int = 0, label: str | None = None) -> DataFrame:
    """A level of a pyramid; a path with ?slices=[...] is read where the slices are."""
    base, indices = split_query(path)
    df = spark.read.parquet(f"{base}/{'labels/' + label if label else 'image'}/level={level}")
    if indices is None:
        return df
    meta = read_metadata(spark, base)
    axes = tuple(a["name"] for a in meta["multiscales"][0]["axes"])
    step = 2**level
    shape = tuple(n if k < len(axes) - 2 else -(-n // step) for k, n in enumerate(meta["shape"]))
    return sliced(df, indices, shape, axes)
