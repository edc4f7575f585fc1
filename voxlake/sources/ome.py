"""Image pyramids as OME-Zarr: written chunk by chunk by the tasks, read with slices that skip chunks.

An image is a group with one Zarr version 2 array for each level and multiscale metadata; labels are
images of their own below labels/. A chunk is one group of voxels and one file, so the largest thing a
task holds is a chunk, and a task that runs again writes the same bytes to the same names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.reduction import pyramid
from voxlake.sources import codecs
from voxlake.sources.arrays import ZarrSource, array_metadata, open_store, store_of
from voxlake.sources.metadata import checked_axes, label_metadata, level_scales, multiscales
from voxlake.sources.paths import sliced, split_query

#: How the images of a production run are stored.
STORED = {"id": "blosc", "cname": "lz4", "clevel": 9, "shuffle": 2}


def storage_options(options: dict | Sequence[dict] | None, levels: int) -> list[dict]:
    """The options of each level: one dictionary for all, or one for each."""
    if options is None or isinstance(options, dict):
        return [dict(options or {})] * (levels + 1)
    if len(options) <= levels:
        raise ValueError(f"{len(options)} options for {levels + 1} levels")
    return [dict(o) for o in options]


def full_chunks(chunks: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    """Chunks for all axes of shape: leading axes that chunks does not name are whole, none exceeds its axis."""
    missing = len(shape) - len(chunks)
    if missing < 0:
        raise ValueError(f"{len(chunks)} chunks for {len(shape)} axes")
    return tuple(min(n, c) if n else 1 for n, c in zip(shape, (*shape[:missing], *chunks), strict=True))


def _put(path: str, name: str, raw: bytes) -> None:
    fs, root = open_store(path)
    target = f"{root}/{name}"
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(target, compression=None) as out:
        out.write(raw)


def _level_shape(shape: Sequence[int], level: int) -> tuple[int, ...]:
    return tuple(n if k < len(shape) - 2 else -(-n // 2**level) for k, n in enumerate(shape))


def write_levels(df: DataFrame, path: str, shape: Sequence[int], chunks: Sequence[int], levels: int, axes: Sequence[str], dtype: str, value: str = "v", options: dict | Sequence[dict] | None = None, fill: float = 0) -> DataFrame:
    """Writes all levels of a volume; a row for each chunk stored: level, chunk, voxels, bytes. Nothing runs before an action."""
    chosen = [{"compressor": STORED} | o for o in storage_options(options, levels)]
    shapes = [_level_shape(shape, k) for k in range(levels + 1)]
    cut = [full_chunks(o.get("chunks", chunks), s) for o, s in zip(chosen, shapes, strict=True)]
    kind = np.dtype(dtype).newbyteorder("<")
    for k, (s, c, o) in enumerate(zip(shapes, cut, chosen, strict=True)):
        meta = {"zarr_format": 2, "shape": list(s), "chunks": list(c), "dtype": kind.str, "compressor": o["compressor"], "fill_value": fill, "order": "C", "filters": None, "dimension_separator": "/"}
        _put(path, f"{k}/.zarray", json.dumps(meta).encode())

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        level, names = int(rows["level"].iloc[0]), [int(rows[f"b{a}"].iloc[0]) for a in axes]
        size = cut[level]
        chunk = np.full(size, fill, kind)
        chunk[tuple((rows[a].to_numpy() - b * c) for a, b, c in zip(axes, names, size, strict=True))] = rows[value].to_numpy()
        name = "/".join(map(str, names))
        if (chunk == fill).all():
            return pd.DataFrame({"level": [level], "chunk": [name], "voxels": [len(rows)], "bytes": [0]})
        raw = codecs.encoded(chunk.tobytes(), chosen[level]["compressor"], kind.itemsize)
        _put(path, f"{level}/{name}", raw)
        return pd.DataFrame({"level": [level], "chunk": [name], "voxels": [len(rows)], "bytes": [len(raw)]})

    each = pyramid(df.select(*axes, value), levels) if levels else df.select(*axes, value).withColumn("level", F.lit(0))
    keys = {f"b{a}": reduce(lambda e, k, i=i: F.when(F.col("level") == k, F.floor(F.col(axes[i]) / cut[k][i])).otherwise(e), range(levels + 1), F.lit(None)).cast("int") for i, a in enumerate(axes)}
    return each.withColumns(keys).groupBy("level", *keys).applyInPandas(write, "level int, chunk string, voxels long, bytes long")


def write_image(spark: SparkSession, path: str, volume: DataFrame, shape: Sequence[int], chunks: Sequence[int], levels: int = 0, axes: Sequence[str] = ("z", "y", "x"), dtype: str = "<u2", options: dict | Sequence[dict] | None = None, labels: DataFrame | None = None, label_name: str = "label", label_dtype: str = "<i4", name: str | None = None, **more: object) -> int:
    """An OME-Zarr image of a volume (v), with labels (lbl) beside it if given; returns the number of chunk files."""

    def group(at: str, kind: str, column: str, df: DataFrame, called: str | None, extra: dict) -> int:
        datasets = [{"path": str(k), "coordinateTransformations": t} for k, t in enumerate(level_scales(len(axes), levels))]
        _put(at, ".zgroup", b'{"zarr_format": 2}')
        done = write_levels(df, at, shape, chunks, levels, axes, kind, column, options).agg(F.count_if(F.col("bytes") > 0)).first()[0]
        _put(at, ".zattrs", json.dumps(multiscales(datasets, checked_axes(list(axes), len(axes)), called, **(more if not extra else {})) | extra).encode())
        return done

    files = group(path, dtype, "v", volume, name, {})
    if labels is not None:
        _put(path, "labels/.zgroup", b'{"zarr_format": 2}')
        files += group(f"{path}/labels/{label_name}", label_dtype, "lbl", labels, label_name, label_metadata())
        _put(path, "labels/.zattrs", json.dumps({"labels": [label_name]}).encode())
    return files


def attributes(path: str) -> dict:
    raw = store_of(path).read(".zattrs")
    return json.loads(raw) if raw else {}


def read_image(spark: SparkSession, path: str, level: int = 0, label: str | None = None, sparse: bool = False) -> DataFrame:
    """A level of an OME-Zarr image, or of its label; a path with ?slices=[...] reads only the chunks that it needs."""
    base, indices = split_query(path)
    at = f"{base}/labels/{label}" if label else base
    axes = [a["name"] for a in attributes(at)["multiscales"][0]["axes"]]
    shape = array_metadata(store_of(at), str(level))["shape"]
    spark.dataSource.register(ZarrSource)
    reader = spark.read.format("zarr2").option("level", str(level)).option("axes", "".join(axes)).option("sparse", str(sparse).lower())
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if indices is None:
        return reader.load(at)
    return sliced(reader.option("slices", path.partition("?slices=")[2]).load(at), indices, tuple(shape), tuple(axes))


def smoke_test(spark: SparkSession, path: str) -> bool:
    """Whether a small image, written by the tasks at path, comes back the same; the path must be free."""
    fs, root = open_store(path)
    if fs.get_file_info(root).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    volume = spark.range(4 * 6 * 5).selectExpr("id div 30 as z", "id div 5 % 6 as y", "id % 5 as x", "cast(id as double) as v")
    try:
        write_image(spark, path, volume, (4, 6, 5), (2, 4, 4), 1, dtype="<u2")
        return read_image(spark, path).exceptAll(volume.select("z", "y", "x", "v")).isEmpty() and read_image(spark, path, 1).count() == 4 * 3 * 3
    finally:
        fs.delete_dir(root)
