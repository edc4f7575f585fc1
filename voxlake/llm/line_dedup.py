"""Line deduplication by a log-template tree of fixed depth.

A line's tokens that hold digits become the wildcard. The tree's first level is the token count, the
next DEPTH levels are the leading tokens; a leaf holds templates. A line joins the template that agrees
with it in most positions, if that is at least SIMILAR of them, and positions that differ become
wildcards; else it begins a template. So variable fields generalise whatever they hold. Lines under
GENERAL tokens only match when all tokens agree. A line of under BARE tokens that all hold digits keeps them, as
wildcards alone would make one template of all numbers. Only lines under LEAST tokens, the blank ones, are left out.

A template that occurs in at least min_docs documents recurs; its lines are dropped from all documents but
the first (the smallest id), or with keep_first=False from all. Blank lines stay.

Every leaf is clustered by one rule, whatever its size: its lines fall into SLOTS by their digest, each
slot's lines are placed in the order of their digest, and the templates of all slots are then placed
once more in one tree. A leaf of up to hot_lines lines is done in one task; a larger one, of which there are
at most MOST_HOT, has its slots in tasks of their own and the templates merged after. Which of the two
happens changes no result.

Masked lines are counted where they lie before they are dealt to leaves, with the min_docs smallest ids that
hold them, so a line that a third of all documents hold travels once per task, and whether a template
recurs is known where it is made. Templates are found through an index of tokens by position: one that a
line can join agrees with it in at least SHARED of its positions, so the longest lists need no look.

Edge cases: null texts stay null, empty texts empty; neither has lines. Null ids are documents of their own kind:
smaller than any other and taken as one document. Rows that repeat an id are one document for counting, and each
is cut at its own lines. Ties between templates go to the oldest, so the result does not depend on partitions
or on the order of rows. An empty table gives an empty result. Very long texts are treated line by line. Columns
besides the text pass through drop_recurring untouched, whatever their names; where docs has a column n_lines
or n_dropped, the new one's name gets underscores until it is free.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, free_name, written

DEPTH = 3
LEAST, BARE, GENERAL, SIMILAR = 1, 5, 8, 0.7
#: Share of its positions in which a line agrees with the fixed tokens of any template it can join: a
#: wildcard counts half, and no template of SIMILAR lines has more than 2 (1 - SIMILAR) of them.
SHARED = 2 * SIMILAR - 1
WILD = "<*>"
#: Bytes of lines that a map task counts before it sends them on.
LOCAL_BYTES = 24 << 20
SLOTS = 256
#: Lines from which a leaf's slots get tasks of their own, and how many leaves can at most.
HOT_LINES, MOST_HOT = 10_000, 1_000_000
#: Lines that hold over one in FREQUENT of all occurrences are joined by broadcast; there are fewer than that.
FREQUENT = 1_000

_DIGIT = re.compile(r"\d")
_SEED = 42  # of the engine's xxhash64


def masked(line: str) -> list[str]:
    """The line's tokens, those with digits as the wildcard; a short line of such tokens alone stays as it is."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    held = [WILD if _DIGIT.search(t) else t for t in tokens]
    return tokens if len(held) < BARE and held.count(WILD) == len(held) else held


def digest(tokens: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass"))


def slot_of(line: bytes) -> int:
    return line[-1] % SLOTS


def leaf_of(tokens: list[str]) -> int:
    """The leaf: token count and leading tokens; lines too short to generalise are leaves of their own."""
    key = tokens if len(tokens) < GENERAL else tokens[:DEPTH]
    return xxhash.xxh3_64_intdigest(f"{len(tokens)}\0{' '.join(key)}".encode("utf-8", "surrogatepass")) - (1 << 63)


def smallest(a: list[int], b: Iterable[int], most: int) -> list[int]:
    """The most smallest distinct ids of both; a is sorted and changed."""
    for x in b:
        if (len(a) < most or x < a[-1]) and x not in a:
            insort(a, x)
            del a[most:]
    return a


class Leaf:
    """Templates of one leaf, oldest first, with their occurrences and smallest ids."""

    #: Templates from which the index is used.
    MANY = 48

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.words: dict[str, int] = {}
        self.names: list[bytes] = []
        self.rows: list[int] = []
        self.docs: list[list[int]] = []
        self.templates = np.zeros((0, 0), np.int32)
        self.lists: dict[tuple[int, int], list[int]] = defaultdict(list)

    def _candidates(self, ids: np.ndarray) -> np.ndarray | slice:
        if len(self.names) < self.MANY:
            return slice(0, len(self.names))
        lists = sorted((self.lists.get((k, i), ()) for k, i in enumerate(ids.tolist()) if i >= 0), key=len)
        enough = max(1, len(ids) - int(np.ceil(SHARED * len(ids) - 1e-9)) + 1 - int((ids < 0).sum()))
        found = set().union(*lists[:enough]) if lists else set()
        return np.array(sorted(found), np.int64)

    def place(self, name: bytes, tokens: list[str], n: int, docs: list[int]) -> int:
        """The number of the template that the line joins; a new one if it begins one."""
        ids = np.array([-1 if t == WILD else self.words.setdefault(t, len(self.words)) for t in tokens], np.int32)
        if self.names:
            at = self._candidates(ids)
            held = self.templates[at]
            if len(held):
                # a wildcard agrees by half with whatever stands there
                fixed = held >= 0
                same = ((held == ids) & fixed).sum(1) + (~fixed).sum(1) * 0.5
                best = int(np.argmax(same))
                if same[best] >= SIMILAR * len(ids) - 1e-9:
                    k = best if isinstance(at, slice) else int(at[best])
                    row = self.templates[k]
                    row[row != ids] = -1
                    self.rows[k] += n
                    smallest(self.docs[k], docs, self.min_docs)
                    return k
        if len(self.names) == len(self.templates):
            grown = np.full((max(4, 2 * len(self.templates)), len(ids)), -2, np.int32)
            if len(self.templates):
                grown[: len(self.templates)] = self.templates
            self.templates = grown
        k = len(self.names)
        self.templates[k] = ids
        for position, i in enumerate(ids.tolist()):
            if i >= 0:
                self.lists[position, i].append(k)
        self.names.append(name)
        self.rows.append(n)
        self.docs.append(list(docs))
        return k

    def found(self) -> Iterator[tuple[bytes, str, int, list[int]]]:
        """Name, text, occurrences and smallest ids of each template."""
        back = list(self.words)
        for name, row, n, docs in zip(self.names, self.templates.tolist(), self.rows, self.docs):
            yield name, " ".join(WILD if i < 0 else back[i] for i in row), n, docs


def merged(templates: list[tuple[bytes, str, int, list[int]]], min_docs: int) -> dict[bytes, list[int]]:
    """For each template of any slot, the smallest ids of the one that it becomes part of."""
    tree = Leaf(min_docs)
    into = {name: tree.place(name, text.split(" "), n, docs) for name, text, n, docs in sorted(templates, key=lambda t: t[0])}
    return {name: tree.docs[k] for name, k in into.items()}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i8").tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i8").tolist()


_LINES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line_no", pa.int32()), ("leaf", pa.int64()), ("line", pa.binary())])
_LINES_DDL = "doc_id long, row long, line_no int, leaf long, line binary"
_COUNTED = pa.schema([("leaf", pa.int64()), ("slot", pa.int32()), ("line", pa.binary()), ("text", pa.string()), ("n", pa.int64()), ("docs", pa.binary())])
_COUNTED_DDL = "leaf long, slot int, line binary, text string, n long, docs binary"
#: Settled lines have first; lines of a hot leaf have their slot's template, and those templates have text.
_PLACED = pa.schema([("leaf", pa.int64()), ("line", pa.binary()), ("template", pa.binary()), ("text", pa.string()), ("n", pa.int64()), ("docs", pa.binary()), ("first", pa.int64())])
_PLACED_DDL = "leaf long, line binary, template binary, text string, n long, docs binary, first long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, text.as_py()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for doc_id, text in _texts(batches):
            if text:
                row = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), _SEED)
                row -= (row >> 63) << 64
                for i, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    if len(tokens) >= LEAST:
                        yield doc_id, row, i, leaf_of(tokens), digest(tokens)

    yield from by_bytes(found(), _LINES, lambda r: 44)


def _counts(min_docs: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            held: dict[str, list] = {}
            size = 0
            for doc_id, text in _texts(batches):
                for line in {" ".join(t) for t in map(masked, (text or "").split("\n")) if len(t) >= LEAST}:
                    known = held.get(line)
                    if known is None:
                        size += len(line) + 160
                        held[line] = [1, [doc_id]]
                    else:
                        known[0] += 1
                        smallest(known[1], (doc_id,), min_docs)
                if size > LOCAL_BYTES:
                    yield from held.items()
                    held, size = {}, 0
            yield from held.items()

        def rows():
            for line, (n, docs) in found():
                tokens = line.split(" ")
                name = digest(tokens)
                yield leaf_of(tokens), slot_of(name), name, line, n, _packed(docs)

        yield from by_bytes(rows(), _COUNTED, lambda r: 60 + len(r[3]))

    return count


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _place(min_docs: int):
    """Rows (leaf, slot, line, text, n, docs, hot) in order of leaf, slot and line: what recurs, or a hot leaf's templates."""

    def lines(group) -> Iterator[tuple]:
        for line, same in groupby(group, key=lambda r: r[2]):
            first = next(same)
            n, docs = first[4], _unpacked(first[5])
            for r in same:
                n += r[4]
                smallest(docs, _unpacked(r[5]), min_docs)
            yield line, first[3], n, docs

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for leaf, group in groupby(_rows(batches), key=lambda r: r[0]):
                first = next(group)
                second = next(group, None)
                if second is None and not first[6]:
                    if len(first[5]) // 8 >= min_docs:
                        yield leaf, first[2], None, None, first[4], None, _unpacked(first[5])[0]
                    continue
                hot, templates, of = first[6], [], []
                for _, own in groupby(_chained(first, second, group), key=lambda r: r[1]):
                    tree = Leaf(min_docs)
                    for line, text, n, docs in lines(own):
                        k = tree.place(line, text.split(" "), n, docs)
                        of.append((line, tree.names[k], n))
                    if hot:
                        yield from ((leaf, None, name, text, n, _packed(docs), None) for name, text, n, docs in tree.found())
                        yield from ((leaf, line, name, None, n, None, None) for line, name, n in of)
                        of = []
                    else:
                        templates += tree.found()
                if not hot:
                    docs_of = merged(templates, min_docs)
                    for line, name, n in of:
                        if len(docs := docs_of[name]) >= min_docs:
                            yield leaf, line, None, None, n, None, docs[0]

        yield from by_bytes(found(), _PLACED, lambda r: 80 + len(r[3] or ""))

    return place


def _chained(first: tuple, second: tuple | None, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    if second is not None:
        yield second
    yield from rest


def _merge(min_docs: int):
    """Rows (leaf, template, text, n, docs) in order of leaf: templates that recur once all slots are merged."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, group in groupby(_rows(batches), key=lambda r: r[0]):
                for name, docs in merged([(r[1], r[2], r[3], _unpacked(r[4])) for r in group], min_docs).items():
                    if len(docs) >= min_docs:
                        yield name, docs[0]

        yield from by_bytes(found(), pa.schema([("template", pa.binary()), ("first", pa.int64())]), lambda r: 40)

    return merge


def _key(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def recurring_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep_first: bool = True, hot_lines: int = HOT_LINES, frequent: int = FREQUENT) -> DataFrame:
    """The lines to drop: doc_id, row (xxhash64 of the text), line_nos (sorted, from 0)."""
    rows = docs.select(_key(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = written(spark, rows.mapInArrow(_positions, _LINES_DDL), "lines")
    total = lines.count()
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("c"))
    bar = max(hot_lines, total // MOST_HOT)
    hot = sizes.where(F.col("c") > bar).select("leaf", F.lit(True).alias("hot"))  # at most MOST_HOT rows, by the bar
    counted = rows.mapInArrow(_counts(min_docs), _COUNTED_DDL).join(F.broadcast(hot), "leaf", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    task = F.when(F.col("hot"), F.col("slot")).otherwise(F.lit(-1))
    dealt = counted.withColumn("task", task).repartition("leaf", "task").sortWithinPartitions("leaf", "slot", "line").drop("task")
    placed = written(spark, dealt.mapInArrow(_place(min_docs), _PLACED_DDL), "templates")
    open_templates = placed.where("text is not null").select("leaf", "template", "text", "n", "docs")
    over = open_templates.repartition("leaf").sortWithinPartitions("leaf", "template").mapInArrow(_merge(min_docs), "template binary, first long")
    late = placed.where("text is null and template is not null").select("line", "template", "n").join(over, "template").select("line", "first", "n")
    recurring = placed.where("first is not null").select("line", "first", "n").unionByName(late)

    many = F.col("n") > total / frequent  # fewer than frequent lines
    known = lines.select("doc_id", "row", "line_no", "line").join(F.broadcast(recurring.where(many).select("line", "first")), "line", "left")
    rest = known.where("first is null").drop("first").join(recurring.where(~many).select("line", "first"), "line")
    gone = known.where("first is not null").unionByName(rest)
    if keep_first:
        gone = gone.where("doc_id <> first")
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))


def drop_recurring(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with recurring lines cut out of the text, all other columns as they were, plus n_lines and n_dropped."""
    taken = list(docs.columns)
    mine, n_lines, n_dropped = free_name("cut", taken), free_name("n_lines", taken), free_name("n_dropped", taken)
    gone = recurring_lines(spark, docs, id_col, text_col, **options).select(F.struct("doc_id", "row", "line_nos").alias(mine))
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, (_key(id_col) == F.col(f"{mine}.doc_id")) & (F.xxhash64(text) == F.col(f"{mine}.row")), "left")
    lines = F.split(text, "\n", -1)
    nos = F.coalesce(F.col(f"{mine}.line_nos"), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(nos, i)), "\n")
    cut = F.when(F.col(mine).isNull(), F.col(text_col)).otherwise(kept)
    rest = [cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*rest, F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("long").alias(n_lines), F.size(nos).cast("long").alias(n_dropped))
