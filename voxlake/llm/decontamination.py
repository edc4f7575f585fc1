"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are the runs of letters outside ASCII, a-z and digits, after lower-casing A-Z only. Every
eight consecutive words of a benchmark item are a window; an item of fewer words, but not none, is
one window. The windows become word numbers under a hash set, broadcast to the tasks. A task
numbers each document's words, rolls a hash over stretches of known words, looks the windows up,
and verifies each hit word by word before it counts.

The set is only broadcast in blocks of proven size: the benchmark's characters are summed first, and a
benchmark over block_chars is scanned in several passes, each with the only block that is broadcast at the
time. A pass writes its hits, which are merged per document, so any size of benchmark gives the same result.
The driver holds two blocks at most.

Edge cases: a null text has no words; so has an empty one. Items without an id, or without words,
never hit. Rows that repeat an item's id add to its windows; repeated items with another id hit
together. Repeated document rows are scanned one by one, and with a benchmark of several blocks
merged by id and text. Removal and cutting go by row. Empty tables give empty results or no hits. Very long texts
are scanned whole. Other columns are not looked at, whatever their names, and pass through decontaminate.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm._core import by_bytes, free_name, written

WINDOW = 8
#: Characters of benchmark text that one broadcast holds at most.
BLOCK_CHARS = 4_000_000
#: Bytes to lower case, and those that separate words to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class WindowSet:
    """Windows of numbered words by length, in order of their hash, with the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.item_ids)}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if words and item_id is not None:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
                own = np.lib.stride_tricks.sliding_window_view(numbers, min(window, len(words)))
                held[own.shape[1]].append((own, np.full(len(own), number[item_id], np.uint32)))
        #: For each length: hashes, windows, where the items of each begin (and the end), items.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in sorted(held.items()):
            windows, owners = (np.concatenate(column) for column in zip(*parts, strict=True))
            hashes = _rolled(windows[:, k] for k in range(n))
            order = np.lexsort((owners, *windows.T, hashes))
            hashes, windows, owners = hashes[order], windows[order], owners[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (windows[1:] != windows[:-1]).any(1)
            again = ~new
            again[1:] &= owners[1:] == owners[:-1]
            hashes, windows, owners, new = hashes[~again], windows[~again], owners[~again], new[~again]
            self.tables[n] = hashes[new], windows[new], np.append(np.flatnonzero(new), len(owners)), owners

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Verified occurrences as (first word, length), and the items they come from."""
        found, items = [], set()
        if not self.tables or not words:
            return found, items
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, len(words))
        at = np.arange(len(numbers))
        last_unknown = np.maximum.accumulate(np.where(numbers == 0, at, -1))
        known = at - last_unknown  # known words that end here
        for n, (hashes, windows, begin, owners) in self.tables.items():
            starts = np.flatnonzero(known >= n) - n + 1
            if not len(starts):
                continue
            rolled = _rolled(numbers[starts + k] for k in range(n))
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            likely = np.flatnonzero(hashes[place] == rolled)
            for i, k in zip(starts[likely].tolist(), place[likely].tolist(), strict=True):
                own, h = numbers[i : i + n], hashes[k]
                while k < len(hashes) and hashes[k] == h:  # windows of one hash stand side by side
                    if (windows[k] == own).all():
                        found.append((i, n))
                        items.update(owners[begin[k] : begin[k + 1]].tolist())
                        break
                    k += 1
        return found, {self.item_ids[i] for i in items}


def _rolled(columns: Iterable[np.ndarray]) -> np.ndarray:
    """A hash of each row, given the columns of word numbers."""
    out = np.uint64(0)
    for column in columns:
        out = (out ^ column.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def covered(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hits merged into disjoint word ranges [start, stop)."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n))
        else:
            out.append((start, start + n))
    return out


def without_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the bytes from each range's first word to its last."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    kept, at = [], 0
    for start, stop in ranges:
        kept.append(raw[at : spans[start][0]])
        at = spans[stop - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows in lists of at most block_chars characters (or one row), fetched in turn."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where("i is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= block_chars:
        yield [tuple(r) for r in rows.collect()]
        return
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


_SCAN = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_SCAN_DDL = "doc_id long, digest binary, ranges array<long>, items array<string>"
_WORDS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64())])
_WORDS_DDL = "doc_id long, digest binary, n_words long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "doc_id long, n_words long, n_hit long, ranges array<long>, items array<string>"


def _summed(ranges: list[int], items: list[str]) -> tuple[int, list[int], list[str]]:
    merged = covered([(a, b - a) for a, b in zip(ranges[::2], ranges[1::2], strict=True)])
    return sum(b - a for a, b in merged), [x for r in merged for x in r], sorted(set(items))


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, ranges (flat word ranges), items (sorted)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    single, blocks = _single(_blocks(benchmark, item_id_col, item_text_col, block_chars))
    if single is not None:
        return rows.mapInArrow(_scan_once(spark.sparkContext.broadcast(WindowSet(single, window))), _FOUND_DDL)
    hits = _merged(spark, rows, blocks, window).select(F.struct("doc_id", "digest").alias("row"), "m")
    joined = rows.mapInArrow(_count_words, _WORDS_DDL).join(hits, F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("digest") == F.col("row.digest")), "left")
    none = F.array()
    return joined.select("doc_id", "n_words", F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("m.ranges", none.cast("array<long>")).alias("ranges"), F.coalesce("m.items", none.cast("array<string>")).alias("items"))


def _single(blocks: Iterator[list]) -> tuple[list | None, Iterator[list]]:
    """The only block, or None and all of several."""
    first, second = next(blocks, []), next(blocks, None)
    return (first, iter(())) if second is None else (None, chain([first, second], blocks))


def _merged(spark: SparkSession, rows: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """A row for each distinct (doc_id, digest) of rows with hits: m (n_hit, ranges, items).

    One block is broadcast at a time; its hits are written before the next takes its place.
    """
    found = None
    for block in blocks:
        windows = spark.sparkContext.broadcast(WindowSet(block, window))
        hits = written(spark, rows.mapInArrow(_scan_keyed(windows), _SCAN_DDL).dropDuplicates(["doc_id", "digest"]), "hits")
        windows.destroy()
        found = hits if found is None else found.unionAll(hits)
    merge = F.udf(lambda r, i: _summed([x for part in r for x in part], [x for part in i for x in part]), T.StructType().add("n_hit", T.LongType()).add("ranges", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType())))
    return found.groupBy("doc_id", "digest").agg(merge(F.collect_list("ranges"), F.collect_list("items")).alias("m"))  # a block has a row at most


def _same_row(id_col: str, text_col: str, hit: str):
    """Whether a row has the id and the text that the struct column hit names (doc_id, digest)."""
    text = F.col(text_col).cast("string")
    raw = F.when(text.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), text.cast("binary")))
    return (F.unhex(F.sha2(raw, 256)) == F.col(f"{hit}.digest")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{hit}.doc_id"))


def _cleaned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mode: str, id_col: str, text_col: str, least_items: int, item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """With a benchmark of one block, a single pass without a shuffle; else hits are merged by id and digest first."""
    single, blocks = _single(_blocks(benchmark, item_id_col, item_text_col, block_chars))
    spans = mode == "spans"
    if single is not None:
        windows = spark.sparkContext.broadcast(WindowSet(single, window))
        return docs.mapInArrow(_clean_once(windows, docs.columns.index(text_col), least_items, spans), docs.schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mine = free_name("hit", docs.columns)
    hit = _merged(spark, rows, blocks, window).where(F.size("m.items") >= least_items).select(F.struct("doc_id", "digest", F.col("m.ranges").alias("ranges")).alias(mine))
    if not spans:
        return docs.join(hit, _same_row(id_col, text_col, mine), "left_anti")
    cut = F.udf(lambda t, r: t if t is None or r is None else without_words(t, list(zip(r[::2], r[1::2], strict=True))), "string")
    joined = docs.join(hit, _same_row(id_col, text_col, mine), "left")
    return joined.select(*[cut(F.col(text_col), F.col(f"{mine}.ranges")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _clean_once(windows, at: int, least_items: int, spans: bool):
    """Batches of whole rows, the text in column at; hit documents are left out, or their spans are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for i, text in enumerate(batch.column(at)):
                hits, items = windows.value.hits(words_of(text.as_py()))
                if len(items) >= least_items and hits:
                    found[i] = covered(hits)
            if not found:
                yield batch
            elif spans:
                texts = [t if i not in found else without_words(t, found[i]) for i, t in enumerate(batch.column(at).to_pylist())]
                columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            else:
                yield batch.filter(pa.array([i not in found for i in range(len(batch))], pa.bool_()))

    return clean


def _scan_once(windows):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words_of(text.as_py())
                    hits, items = windows.value.hits(words)
                    merged = covered(hits)
                    yield doc_id, len(words), sum(b - a for a, b in merged), [x for r in merged for x in r], sorted(items)

        yield from by_bytes(found(), _FOUND, lambda r: 48 + 8 * len(r[3]) + 16 * len(r[4]))

    return scan


def _digest(text: str | None) -> bytes:
    return hashlib.sha256(b"\0" if text is None else b"\1" + text.encode("utf-8", "surrogatepass")).digest()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, text.as_py()


def _scan_keyed(windows):
    """The rows with hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, text in _texts(batches):
                hits, items = windows.value.hits(words_of(text))
                if hits:
                    yield doc_id, _digest(text), [x for r in covered(hits) for x in r], sorted(items)

        yield from by_bytes(found(), _SCAN, lambda r: 80 + 8 * len(r[2]) + 16 * len(r[3]))

    return scan


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from by_bytes(((doc_id, _digest(text), len(words_of(text))) for doc_id, text in _texts(batches)), _WORDS, lambda r: 60)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, **options) -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit spans cut out of them.

    A document is contaminated when windows of at least least_items items occur in it.
    """
    return _cleaned(spark, docs, benchmark, mode, id_col, text_col, least_items, **options)
