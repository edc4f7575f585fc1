"""Tables in the folder that every machine shares, and staged results with a commit marker."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

MARKER = "_committed"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every machine sees")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def written(spark: SparkSession, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. codec compresses it, if named."""
    path = f"{shared_dir(spark).rstrip('/')}/voxlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes the folder of a table that written() made and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/voxlake/" in folder:
            Files(spark, folder).remove()


class Files:
    """A folder by URI on any file system that Spark reads; files[name] is a folder below it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __getitem__(self, name: str) -> Files:
        return Files(self.spark, f"{self.root}/{name}")

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}".rstrip("/")))

    def make(self, clear: bool = False) -> Files:
        if clear:
            self.remove()
        self._fs.mkdirs(self._path(self.root))
        return self

    def remove(self, name: str = "") -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}".rstrip("/")), True)

    def names(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def copy_to(self, name: str, target: Files, new_name: str | None = None) -> None:
        """A streamed copy of one file, between any two file systems."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self._fs, self._path(f"{self.root}/{name}"), target._fs, self._path(f"{target.root}/{new_name or name}"), False, True, conf)


@dataclass(frozen=True)
class StageState:
    """When a stage was committed; None if it never was."""

    commit: datetime | None


def stage_state(files: Files) -> StageState:
    if not files.exists(MARKER):
        return StageState(None)
    return StageState(datetime.fromisoformat(files.read_text(MARKER).strip()))


def stage_begin(files: Files) -> StageState:
    """The state of a stage; what an earlier run left without a commit is wiped."""
    state = stage_state(files)
    if state.commit is None:
        files.make(clear=True)
    return state


def stage_commit(files: Files) -> None:
    files.write_text(MARKER, datetime.now(timezone.utc).isoformat())


def cached(spark: SparkSession, make: DataFrame | Callable[[], DataFrame], path: str | None = None, partitions: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A stage's result: read again if it was committed at path, else made, written and committed.

    Without a path it is pinned in memory and on disk for the session. partitions and keys set
    how the written table is dealt, independently of how it was computed.
    """
    build = make if callable(make) else lambda: make
    if path is None:
        return persist(build())
    files = Files(spark, path)
    if stage_begin(files).commit is None:
        df = build()
        if partitions or keys:
            df = df.repartition(*([partitions] if partitions else []), *keys)
        df.write.parquet(f"{path}/data")
        files.write_text("schema.json", df.schema.json())
        stage_commit(files)
    return spark.read.parquet(f"{path}/data")


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def save_json(files: Files, name: str, value: object) -> None:
    files.write_text(name, json.dumps(value, indent=1))


def load_json(files: Files, name: str) -> object:
    return json.loads(files.read_text(name))


@contextmanager
def temporary_folder(spark: SparkSession) -> Iterator[Files]:
    """A folder below the shared one that goes when the block ends."""
    files = Files(spark, f"{shared_dir(spark).rstrip('/')}/voxlake/temporary-{uuid.uuid4().hex}").make()
    try:
        yield files
    finally:
        files.remove()
