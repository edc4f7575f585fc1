"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after lower-casing A-Z only. The records are first
reduced where they lie: a bounded table in each map task absorbs its own copies, so that of a text
that a third of all rows hold each task sends one record. What is left is dealt by content digest
into buckets (the shuffle files are the first level of spill files). A bucket is then absorbed by
an open-addressing table with a byte budget; records that no longer fit go to spill files by the
next bits of their digest, and each file is treated the same way in turn, until every remaining
bucket fits. The table compares complete contents, never digests alone.

The spill files are scratch of one task attempt, unlinked as they are opened, like those of the
engine's own sorts: nothing else reads them, and a task that is run again makes its own.

Edge cases: a null text counts as the empty text, and empty texts are equal to each other. A null
id is smaller than any other. Repeated rows count one by one in group_size; rows that repeat both
id and text carry the same id, so group_exact marks all of them as kept; deduplicate keeps one. An empty
table gives an empty result. Other columns are not looked at, whatever their names, and pass through deduplicate.
Of a text that a third of all rows hold, each map task sends one record; the join that names its group is
between narrow rows, by broadcast for the texts of over one row in a thousand.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, free_name, join_frequent, written

#: Bytes of content that the table of one task holds.
TABLE_BYTES = 64 << 20
#: Bytes of content that a map task holds to absorb its own copies.
LOCAL_BYTES = 24 << 20
FAN_OUT = 16

Record = tuple[bytes, bytes, int | None, int]  # digest, content, largest id, rows

RECORDS = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("rows", pa.int64())])
GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("own", pa.binary())])


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z, and nothing else, in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class OpenTable:
    """Open addressing with linear probing; equal means equal content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (e := self.slots[at]) >= 0 and self.entries[e][1] != content:
            at = (at + 1) & mask
        return at

    def absorb(self, record: Record, budget: int) -> bool:
        """False if the content is new and no longer fits."""
        digest, content, keep, rows = record
        at = self._slot(digest, content)
        if (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            entry[2] = keep if entry[2] is None or keep is not None and keep > entry[2] else entry[2]
            entry[3] += rows
            return True
        if self.entries and self.bytes + len(content) > budget:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, keep, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for e, entry in enumerate(self.entries):
                self.slots[self._slot(entry[0], entry[1])] = e
        return True


_HEAD = struct.Struct("<32s?qqq")


def _spill(file, record: Record) -> None:
    digest, content, keep, rows = record
    file.write(_HEAD.pack(digest, keep is not None, keep or 0, rows, len(content)))
    file.write(content)


def _unspill(file) -> Iterator[Record]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        digest, known, keep, rows, size = _HEAD.unpack(head)
        yield digest, file.read(size), keep if known else None, rows


def grace(records: Iterable[Record], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content: largest id and number of rows."""
    table, files = OpenTable(), {}
    try:
        for record in records:
            if not table.absorb(record, budget):
                k = record[0][level % 24] % FAN_OUT
                if k not in files:
                    files[k] = tempfile.TemporaryFile()  # noqa: SIM115
                _spill(files[k], record)
        yield from map(tuple, table.entries)
        del table
        for k in sorted(files):
            yield from grace(_unspill(files[k]), budget, level + 1)
            files.pop(k).close()
    finally:
        for file in files.values():
            file.close()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = normalised(text.as_py())
            yield hashlib.sha256(content).digest(), content, doc_id, 1


def _absorbed(records: Iterator[Record], budget: int) -> Iterator[Record]:
    """The records, with copies that meet in a bounded table made one."""
    table = OpenTable()
    for record in records:
        if not table.absorb(record, budget):
            yield from map(tuple, table.entries)
            table = OpenTable()
            table.absorb(record, budget)
    yield from map(tuple, table.entries)


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, digest, own (the digest of the text as it is), keep_id, group_size, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def reduce_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_bytes(_absorbed(_records(batches), local_bytes), RECORDS, lambda r: len(r[1]) + 64)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def deduplicate_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((d, keep, n) for d, _, keep, n in grace(unpacked(batches), table_bytes))
        yield from by_bytes(found, GROUPS, lambda r: 64)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, own = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found.append(hashlib.sha256(raw.lower()).digest())
                own.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(own, pa.binary())], schema=DIGESTS)

    sent = rows.mapInArrow(reduce_locally, "digest binary, content binary, keep_id long, rows long")
    spark = docs.sparkSession
    groups = written(spark, sent.repartition("digest").mapInArrow(deduplicate_bucket, "digest binary, keep_id long, group_size long"), "contents")
    members = written(spark, rows.mapInArrow(digests, "doc_id long, digest binary, own binary"), "digests")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    found = join_frequent(members, groups.withColumn("rows", F.col("group_size")), ["digest"], "rows", total)
    return found.select("doc_id", "digest", "own", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """docs with one row of those with equal texts, that with the largest id; all columns stay.

    Rows go by id and their own text's digest, as rows that share an id, or have none, need not share a text. Where
    several rows share the largest id and the text, the one whose columns have the least hash stays.
    """
    spark = docs.sparkSession
    mine, at = free_name("own", docs.columns), free_name("at", docs.columns)
    groups = group_exact(docs, id_col, text_col, **limits).where("not kept or group_size > 1")
    groups = written(spark, groups.select("doc_id", "digest", "own", "kept"), "groups")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a column of its own, so that the digest is made once for each row and not where keys are compared
    placed = docs.select(*columns, F.unhex(F.sha2(raw, 256)).alias(at))

    def met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        right = keys.select(F.struct("doc_id", "digest", "own").alias(mine))
        return rows.join(right, (F.col(at) == F.col(f"{mine}.own")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{mine}.doc_id")), how)

    rest = met(placed, groups.where("not kept").dropDuplicates(["doc_id", "own"]), "left_anti")
    kept = groups.where("kept")
    twice = kept.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("digest").alias("text"))
    repeated = kept.join(twice, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text")), "left_semi").dropDuplicates(["doc_id", "own"])
    if twice.isEmpty():
        return rest.drop(at)
    several = met(rest, repeated, "inner").groupBy(f"{mine}.doc_id", f"{mine}.digest").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return met(rest, repeated, "left_anti").drop(at).unionByName(several.select("row.*"))
