"""Array files: chunked Zarr version 2 stores as a data source, NumPy files, and slices as PNG."""

from __future__ import annotations

import io
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from voxlake.sources import codecs
from voxlake.sources.paths import split_query

AXES = ("t", "c", "z", "y", "x")


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class _Folder:
    def __init__(self, path: str) -> None:
        self.fs, self.root = open_store(path)

    def read(self, name: str) -> bytes | None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pa.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            return f.read()


class _Zip:
    def __init__(self, path: str) -> None:
        import zipfile

        fs, root = open_store(path)
        self.zip = zipfile.ZipFile(fs.open_input_file(root))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        name = name.strip("/")
        return self.zip.read(name) if name in self.names else None


def store_of(path: str) -> _Folder | _Zip:
    """A folder, or a zip file by its suffix."""
    return _Zip(path) if path.endswith(".zip") else _Folder(path)


def array_metadata(store: _Folder | _Zip, level: str) -> dict:
    raw = store.read(f"{level}/.zarray".lstrip("/"))
    if raw is None:
        raise FileNotFoundError(f"no array at {level or 'the root'}")
    meta = json.loads(raw)
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in codecs.KNOWN or meta.get("filters"):
        raise ValueError(f"chunks compressed with {codec} or filtered by {meta.get('filters')} cannot be read")
    return meta


def read_chunk(store: _Folder | _Zip, level: str, meta: dict, index: tuple[int, ...]) -> np.ndarray | None:
    """A chunk in full size; None where it is not stored and holds the fill value."""
    name = meta.get("dimension_separator", ".").join(map(str, index))
    raw = store.read(f"{level}/{name}".lstrip("/"))
    if raw is None:
        return None
    kind = np.dtype(meta["dtype"])
    raw = codecs.decoded(raw, meta.get("compressor"), kind.itemsize * int(np.prod(meta["chunks"])))
    return np.frombuffer(raw, kind).reshape(meta["chunks"], order=meta.get("order", "C"))


class _ChunkPartition(InputPartition):
    def __init__(self, indices: list[tuple[int, ...]]) -> None:
        super().__init__(indices)


class _ZarrReader(DataSourceReader):
    def __init__(self, path: str, level: str, axes: tuple[str, ...], sparse: bool, per_task: int, indices: tuple | None = None) -> None:
        self.path, self.level, self.axes, self.sparse, self.per_task = path, level, axes, sparse, per_task
        self.meta = array_metadata(store_of(path), level)
        #: The voxels wanted along each axis, as half-open ranges.
        self.wanted = [(0, n) for n in self.meta["shape"]]
        for k, index in enumerate(indices or ()):
            n = self.meta["shape"][k]
            at = (index % n, index % n + 1) if isinstance(index, int) else index.indices(n)[:2]
            self._narrow(k, *at)

    def _narrow(self, k: int, low: int, high: int) -> None:
        self.wanted[k] = (max(self.wanted[k][0], low), min(self.wanted[k][1], high))

    def partitions(self) -> list[InputPartition]:
        blocks = [range(low // c, -(-high // c) if high > low else low // c) for (low, high), c in zip(self.wanted, self.meta["chunks"], strict=True)]
        every = list(product(*blocks))
        return [_ChunkPartition(every[i : i + self.per_task]) for i in range(0, len(every), self.per_task)] or [_ChunkPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store = store_of(self.path)
        names = [*self.axes, "v"]
        for index in partition.value:
            chunk = read_chunk(store, self.level, self.meta, index)
            fill = self.meta.get("fill_value") or 0
            if chunk is None:
                if self.sparse:
                    continue
                chunk = np.full(self.meta["chunks"], fill, np.dtype(self.meta["dtype"]))
            start = [i * c for i, c in zip(index, self.meta["chunks"], strict=True)]
            chunk = chunk[tuple(slice(0, n - s) for n, s in zip(self.meta["shape"], start, strict=True))]
            at = np.argwhere(chunk != fill) if self.sparse else np.indices(chunk.shape).reshape(chunk.ndim, -1).T
            values = chunk[tuple(at.T)].astype(np.float64)
            columns = [pa.array(at[:, k] + start[k], pa.int64()) for k in range(chunk.ndim)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names)


class _PushedReader(_ZarrReader):
    """For sessions that push filters into Python sources; others refuse a reader that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of coordinates leave out chunks; all are returned, as the engine looks at each voxel again."""
        for f in filters:
            names = getattr(f, "attribute", ())
            if len(names) == 1 and names[0] in self.axes and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                k, v = self.axes.index(names[0]), f.value
                low = v + 1 if isinstance(f, GreaterThan) else v if isinstance(f, (EqualTo, GreaterThanOrEqual)) else 0
                high = v if isinstance(f, LessThan) else v + 1 if isinstance(f, (EqualTo, LessThanOrEqual)) else self.meta["shape"][k]
                self._narrow(k, math.floor(low), math.ceil(high))
            yield f


class ZarrSource(DataSource):
    """spark.read.format("zarr2").load(path): a row for each voxel of a Zarr version 2 array.

    Options: level (the array's name within the group), axes (such as czyx), sparse (only voxels that
    differ from the fill value), slices (such as [0:64,:,3]: chunks outside are not read, voxels are not
    filtered), chunksPerTask. Chunks are raw or compressed by Blosc (but for its own inner codec), zlib, gzip,
    zstd or lz4; each task reads its own. With pushdown, where spark.sql.python.filterPushdown.enabled is set,
    comparisons of coordinates leave out chunks too.
    """

    @classmethod
    def name(cls) -> str:
        return "zarr2"

    def _axes(self) -> tuple[str, ...]:
        meta = array_metadata(store_of(self.options["path"]), self.options.get("level", ""))
        axes = self.options.get("axes")
        return tuple(axes) if axes else AXES[-len(meta["shape"]) :]

    def schema(self) -> str:
        return ", ".join([f"{a} long" for a in self._axes()] + ["v double"])

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        indices = split_query(f"?slices={o['slices']}")[1] if o.get("slices") else None
        kind = _PushedReader if o.get("pushdown", "false").lower() == "true" else _ZarrReader
        return kind(o["path"], o.get("level", ""), self._axes(), o.get("sparse", "false").lower() == "true", int(o.get("chunksPerTask", "4")), indices)


def write_zarr(array: np.ndarray, path: str, chunks: tuple[int, ...], level: str = "", fill: float = 0) -> None:
    """A small array as a Zarr version 2 store with zlib chunks; chunks of only the fill value are left out."""
    fs, root = open_store(path)
    where = f"{root}/{level}".rstrip("/")
    fs.create_dir(where, recursive=True)

    def put(name: str, raw: bytes) -> None:
        with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
            out.write(raw)

    meta = {"zarr_format": 2, "shape": list(array.shape), "chunks": list(chunks), "dtype": array.dtype.newbyteorder("<").str, "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}
    put(".zarray", json.dumps(meta).encode())
    for index in product(*[range(-(-n // c)) for n, c in zip(array.shape, chunks, strict=True)]):
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks, strict=True))]
        if (part != fill).any():
            full = np.full(chunks, fill, array.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            put(".".join(map(str, index)), zlib.compress(full.tobytes(), 1))


def read_npy(spark: SparkSession, pattern: str, axes: tuple[str, ...] = ("z", "y", "x"), binary: bool = False) -> DataFrame:
    """path, axes, v: the voxels of NumPy files; with binary, v is whether the value is positive."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    ddl = "path string, " + ", ".join(f"{a} long" for a in axes) + ", v double"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != len(axes):
                    raise ValueError(f"{path} has {a.ndim} dimensions, not {len(axes)}")
                a = (a > 0 if binary else a).astype(np.float64)
                at = np.indices(a.shape).reshape(a.ndim, -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * a.size), *[pa.array(c) for c in at], pa.array(a.ravel())], ["path", *axes, "v"])

    return files.mapInArrow(explode, ddl)


def encode_png(image: np.ndarray) -> bytes:
    """An eight-bit grey or three-channel image as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """The pixels of an eight-bit grey or three-channel PNG without interlacing."""
    at, data, head = 8, [], ()
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in (0, 2) or interlaced:
        raise ValueError("only plain eight-bit images")
    n = 3 if colour == 2 else 1
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.int64)
    for y in range(height):
        how, line = flat[y, 0], flat[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how:
            for i in range(len(line)):
                left, up, corner = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    add = min((left, up, corner), key=lambda c: abs(p - c))
                line[i] = (line[i] + add) & 255
        out[y] = above = line
    return out.reshape((height, width, 3) if n == 3 else (height, width))


def write_slices(volume: DataFrame, folder: str, shape: tuple[int, int], name: str = "volume", axis: str = "z", rows: str = "y", columns: str = "x", channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """A PNG for each slice of each volume, named volume_slice; returns path and pixels of each file written.

    A volume column tells volumes apart, if there is one. Each slice is one group; missing pixels are 0.
    """
    source = volume if "volume" in volume.columns else volume.withColumn("volume", F.lit(name))
    height, width = shape

    def write(pdf):
        import pandas as pd

        image = np.zeros((height, width, len(channels)), np.uint8)
        image[pdf[rows], pdf[columns]] = pdf[list(channels)].to_numpy()
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        target = f"{root}/{pdf['volume'].iloc[0]}_{int(pdf[axis].iloc[0]):04d}.png"
        with fs.open_output_stream(target, compression=None) as out:
            out.write(encode_png(image if len(channels) == 3 else image[..., 0]))
        return pd.DataFrame({"path": [target], "pixels": [len(pdf)]})

    picked = source.select("volume", axis, rows, columns, *channels)
    return picked.groupBy("volume", axis).applyInPandas(write, "path string, pixels long")


def write_training_set(spark: SparkSession, folder: str, images: DataFrame, labels: DataFrame, shape: tuple[int, int], channels: tuple[str, ...] = ("v",), name: str = "Dataset", classes: tuple[str, ...] = ("background", "foreground")) -> int:
    """Slices of volumes (volume, z, y, x) as PNG for a two-dimensional segmentation model, with dataset.json.

    Each channel of a case goes to imagesTr/<case>_<channel>.png and its labels (lbl) to labelsTr/<case>.png, where a
    case is a volume and a slice number. Returns how many cases were written.
    """
    fs, root = open_store(folder)
    for part in ("imagesTr", "labelsTr"):
        fs.create_dir(f"{root}/{part}", recursive=True)
    height, width = shape

    def write(pdf):
        import pandas as pd

        store, top = open_store(folder)
        case = f"{pdf['volume'].iloc[0]}_{int(pdf['z'].iloc[0]):04d}"
        files = {f"imagesTr/{case}_{k:04d}.png": c for k, c in enumerate(channels)} | {f"labelsTr/{case}.png": "lbl"}
        for file, column in files.items():
            image = np.zeros((height, width), np.uint8)
            image[pdf["y"], pdf["x"]] = pdf[column].to_numpy()
            with store.open_output_stream(f"{top}/{file}", compression=None) as out:
                out.write(encode_png(image))
        return pd.DataFrame({"case": [case]})

    keys = ["volume", "z", "y", "x"]
    both = images.select(*keys, *channels).join(labels.select(*keys, "lbl"), keys, "left").withColumn("lbl", F.coalesce("lbl", F.lit(0)))
    cases = both.groupBy("volume", "z").applyInPandas(write, "case string").count()
    described = {"name": name, "channel_names": {str(k): c for k, c in enumerate(channels)}, "labels": {c: k for k, c in enumerate(classes)}, "numTraining": cases, "file_ending": ".png"}
    with fs.open_output_stream(f"{root}/dataset.json", compression=None) as out:
        out.write(json.dumps(described, indent=1).encode())
    return cases


def read_npz(spark: SparkSession, pattern: str, key: str, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """path, axes, v: the voxels of one array of each NumPy archive."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)[key].astype(np.float64)
                if a.ndim != len(axes):
                    raise ValueError(f"{path} has {a.ndim} dimensions, not {len(axes)}")
                at = np.indices(a.shape).reshape(a.ndim, -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * a.size), *[pa.array(c) for c in at], pa.array(a.ravel())], ["path", *axes, "v"])

    return files.mapInArrow(explode, "path string, " + ", ".join(f"{a} long" for a in axes) + ", v double")


def copy_mask(source: str, targets: list[str]) -> None:
    """A file copied to several places on any file systems; the source must exist, and no target may."""
    fs, root = open_store(source)
    if fs.get_file_info(root).type != pa.fs.FileType.File:
        raise FileNotFoundError(source)
    places = [open_store(t) for t in targets]
    if taken := [t for t, (to, at) in zip(targets, places, strict=True) if to.get_file_info(at).type != pa.fs.FileType.NotFound]:
        raise FileExistsError(", ".join(taken))
    for to, at in places:
        to.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_input_stream(root, compression=None) as raw, to.open_output_stream(at, compression=None) as out:
            while piece := raw.read(1 << 20):
                out.write(piece)


def recover_volumes(spark: SparkSession, pattern: str) -> DataFrame:
    """volume, z, y, x, v (and v1, v2): the voxels of slice files named volume_slice.png, slices counted in order.

    Files are ranked within a volume by their slice numbers; three channels come back as three columns.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    file = F.regexp_extract("path", r"([^/]+)_(\d+)\.png$", 1)
    number = F.regexp_extract("path", r"_(\d+)\.png$", 1).cast("int")
    ranked = files.select(file.alias("volume"), number.alias("number")).withColumn("z", (F.row_number().over(Window.partitionBy("volume").orderBy("number")) - 1).cast("long"))
    joined = files.withColumns({"volume": file, "number": number}).join(ranked, ["volume", "number"]).select("volume", "z", "content")
    ddl = "volume string, z long, y long, x long, v int, v1 int, v2 int"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for volume, z, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = decode_png(content).astype(np.int32)
                y, x = np.indices(a.shape[:2]).reshape(2, -1)
                planes = [pa.array(a[..., k].ravel()) for k in range(3)] if a.ndim == 3 else [pa.array(a.ravel()), *[pa.nulls(a.size, pa.int32())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([volume] * a.size), pa.array([z] * a.size), pa.array(y), pa.array(x), *planes], ["volume", "z", "y", "x", "v", "v1", "v2"])

    return joined.mapInArrow(explode, ddl)


def first_existing(paths: list[str], shape: tuple[int, ...]) -> np.ndarray:
    """The first NumPy file that exists, or zeros."""
    for path in paths:
        fs, root = open_store(path)
        if fs.get_file_info(root).type != pa.fs.FileType.NotFound:
            with fs.open_input_stream(root) as f:
                return np.load(io.BytesIO(f.read()), allow_pickle=False)
    return np.zeros(shape, np.uint8)


def plain_or_zip(path: str) -> str | None:
    """path, or path with .zip, whichever exists."""
    for candidate in (path, f"{path}.zip"):
        fs, root = open_store(candidate)
        if fs.get_file_info(root).type != pa.fs.FileType.NotFound:
            return candidate
    return None


def slice_name(path: str) -> tuple[str, int]:
    """Volume and slice number of a slice file's name."""
    m = re.search(r"([^/]+)_(\d+)\.png$", path)
    if not m:
        raise ValueError(f"{path} is not named volume_slice.png")
    return m[1], int(m[2])
