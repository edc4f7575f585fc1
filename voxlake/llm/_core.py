"""Helpers the corpus operators share: bounded samples, batch slicing, record batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.graph import components
from voxlake.storage import shared_dir, written

__all__ = ["by_bytes", "components", "free_name", "join_frequent", "labelled_sample", "shared_dir", "slices", "to_batch", "written"]

#: Bytes of text that a vectorised kernel takes at once.
SLICE_BYTES = 1 << 21


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(text, label) of at most most[label] labelled documents, as a table in the shared folder.

    labels has id_col and label. The ids are chosen by their hash, so a sample does not depend on
    the order of rows; only these ids, whose number most bounds, are broadcast to the documents.
    """
    chosen = None
    for label, n in most.items():
        some = labels.where(F.col("label") == label).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), "label").orderBy(F.xxhash64("__id"), "__id").limit(n)
        chosen = some if chosen is None else chosen.unionAll(some)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    return written(spark, rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "label"), "sample")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no column in taken has it; names differ by more than case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def join_frequent(left: DataFrame, right: DataFrame, key: list[str], count: str, total: int, frequent: int = 1_000) -> DataFrame:
    """The inner join on key, where right has each key once and count is how many rows of left have it.

    Keys of over one in frequent of all rows are fewer than frequent, so they are joined by broadcast and no
    task gets all rows of one; the others are joined by shuffle.
    """
    many = F.col(count) > total / frequent
    new = [c for c in right.columns if c not in (*key, count)]
    marked = left.join(F.broadcast(right.where(many).select(*key, F.struct(*new).alias("__own"))), key, "left")
    rest = marked.where("__own is null").drop("__own").join(right.where(~many).drop(count), key)
    return marked.where("__own is not null").select(*left.columns, "__own.*").unionByName(rest.select(*left.columns, *new))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of at most limit bytes; a longer row stands alone."""
    n, sizes = len(texts), pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    if start < n:
        yield start, n


def by_bytes(rows: Iterator[tuple], schema: pa.Schema, weigh, limit: int = 4 << 20, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about limit bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= limit or len(held) >= most:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
