"""Exact n-gram Jaccard join over whole documents, with set-relation skipping.

A document's set holds its distinct five-word shingles (the whole word sequence where it has fewer
words). Two documents link when 100 * |A & B| >= 75 * |A | B|; the result is each document's
connected component under links.

How it stays exact without comparing all pairs:

1. Documents with equal sets form a class, found by a 128-bit digest of the set. Map tasks send a
   class once, however many copies they hold.
2. Every shingle hash goes to the bucket its high bits name, packed into binary blocks (about five
   bytes a shingle). A bucket counts in how many sets each hash occurs; hashes of one set only can
   be in no intersection and go no further than their number.
3. By document again: in the order of rising frequency, two sets that link share one of the first
   n - ceil(0.75 n) + 1 hashes. Hashes of one set come first, so a document that has that many of
   its own is done: it links with nothing. Frequent hashes, such as those of a passage that many
   documents quote, come last and stay out of the prefixes.
4. The smallest set that has a prefix hash leads it, and a set goes to the leads of its prefix hashes, so
   sets that share one meet in a task. Near copies share their leads, so a set has few. Where the sets of a
   lead are over block_bytes, they are dealt to several tasks and compared with the lead alone, which links
   most of a group of near copies; two that link with the lead need no look at each other. The sets that do
   not are compared among themselves, and those within twice the linking distance of the lead with the
   sets that link with it, in blocks. No other sets of the group can link.
5. Within a task, lists of the index over prefixes are kept in blocks by position, and a block whose
   positions leave too few hashes for the required overlap is skipped at once. A set that is highly
   similar to an earlier one, its pivot, gets its answers from the pivot's: it is only compared with
   pivots, and since Jaccard distance is a metric, a set further from the pivot than the threshold
   plus the distance between the two cannot link. Pairs that the bound leaves open, of clusters not
   yet connected, are verified by their intersections.
6. The connected components of the links, found on distributed tables, are the result.

Set sizes count 64-bit hashes. Overlaps compare 32 bits within a bucket, that is 32 bits plus the
logarithm of the number of buckets.

Edge cases: a document without words or with a null text has the empty set and links with nothing,
nor with another empty one. doc_id is taken as the key: rows that repeat an id come out once each,
and their sets are joined where texts differ. A row without an id comes out with its n_shingles and without
a class or a component, and keep_one keeps it. Rows that repeat an id stay or go together in keep_one. Very long
texts are one set each. An empty table gives an empty result. Other columns are not looked at, whatever their names,
and pass through keep_one.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, components, join_frequent, shared_dir, slices, to_batch, written
from voxlake.llm._text import STEP, U64, buffers, mixed, word_hashes

SHINGLE = 5
#: Links need PART / WHOLE of the union in common.
PART, WHOLE = 75, 100
#: A set within this distance of a pivot, or the distance that links where that is less, joins its cluster.
NEAR = 0.25
#: Bytes of hashes that the sets of one lead hold; the sets of larger ones go in blocks of as much.
BLOCK_BYTES = 1 << 20
#: Narrow rows (under 50 bytes each) that are joined by broadcast.
FEW_ROWS = 400_000
#: Bytes of hashes that one bucket holds on average at most, and what a hash takes there.
BUCKET_BYTES, HASH_BYTES = 64 << 20, 16
#: Set digests that a map task remembers.
REMEMBERED = 400_000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, sorted by document."""
    words, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]

    def rolled(starts: np.ndarray, n: int) -> np.ndarray:
        x = np.full(len(starts), n, U64)
        for k in range(n):
            x = x * STEP + words[starts + k]
        return mixed(x)

    starts = np.arange(max(0, len(words) - size + 1))
    starts = starts[doc[starts] == doc[starts + size - 1]] if len(starts) else starts
    docs, hashes = [doc[starts]], [rolled(starts, size)]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        docs.append(short)
        hashes.append(rolled(begin[short], n))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort((d.astype(U64) << U64(44)) | (h >> U64(20)))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each slice: ids, document of each hash, hashes, set sizes, two digests of each set."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            ids = batch.column(0).slice(a, b - a)
            d, h = shingles(*buffers(batch.column(1).slice(a, b - a)))
            sizes = np.bincount(d, minlength=len(ids))
            one, two = np.zeros(len(ids), U64), np.zeros(len(ids), U64)
            full = np.flatnonzero(sizes)
            if len(full):
                at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                one[full] = np.add.reduceat(mixed(h), at)
                two[full] = np.add.reduceat(mixed(h ^ STEP), at)
            yield ids, d, h, sizes, one, two


_BLOCKS = pa.schema([("label", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("weights", pa.binary())])
_BLOCKS_DDL = "label int, kind int, docs binary, counts binary, tokens binary, weights binary"
_HASHES, _SIZES = 0, 1


def _packed_docs(docs: np.ndarray) -> bytes:
    """Ids as differences, of 32 bits where they fit."""
    steps = np.diff(docs, prepend=0)
    narrow = steps.astype(np.int32)
    return b"\0" + steps.astype("<i8").tobytes() if (narrow != steps).any() else b"\1" + narrow.astype("<i4").tobytes()


def _unpacked_docs(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<i4" if raw[0] else "<i8", offset=1).astype(np.int64))


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    return (mixed(docs.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _to_buckets(labels: list[int]):
    """Map side: each class of the task once, its hashes dealt to buckets in binary blocks."""
    n = len(labels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for held, d, h, sizes, one, two in _sets(batches):
            ids = held.to_numpy(zero_copy_only=False)
            new = np.zeros(len(ids), bool)
            for i, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if sizes[i] and key not in seen:
                    new[i] = True
                    seen.add(key)
            if len(seen) > REMEMBERED:
                seen.clear()
            keep = new[d]
            docs, h = ids[d[keep]], h[keep]
            bucket = ((h >> U64(32)) % U64(n)).astype(np.uint16 if n < 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")  # documents stay together within a bucket
            bucket, docs, tokens = bucket[order], docs[order], (h[order] & U64(0xFFFFFFFF)).astype("<u4")
            rows, cuts = [], _runs(bucket)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = _runs(docs[a:b])
                rows.append((labels[bucket[a]], _HASHES, _packed_docs(docs[a:b][own[:-1]]), np.diff(own).astype("<u4").tobytes(), tokens[a:b].tobytes(), None))
            ids, sizes = ids[new], sizes[new]
            home = _home(ids, n)
            order = np.argsort(home, kind="stable")
            home, ids, sizes = home[order], ids[order], sizes[order]
            cuts = _runs(home)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append((labels[home[a]], _SIZES, _packed_docs(ids[a:b]), sizes[a:b].astype("<u4").tobytes(), None, None))
            if rows:
                yield to_batch(rows, _BLOCKS)

    return deal


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _shared_hashes(labels: list[int]):
    """Bucket side: hashes of two sets or more, with their frequency, dealt to the documents' homes."""
    n, number = len(labels), {label: i for i, label in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, rows in groupby(_rows(batches), key=lambda r: r[0]):
            docs, tokens = [], []
            for row in rows:
                if row[1] == _SIZES:
                    yield to_batch([row], _BLOCKS)
                else:
                    docs.append(np.repeat(_unpacked_docs(row[2]), np.frombuffer(row[3], "<u4")))
                    tokens.append(np.frombuffer(row[4], "<u4"))
            if not docs:
                continue
            d, t = np.concatenate(docs), np.concatenate(tokens)
            del docs, tokens
            order = np.argsort(t)
            d, t = d[order], t[order]
            times = np.diff(_runs(t))
            several = np.repeat(times > 1, times)
            d, t = d[several], t[several]
            order = np.lexsort((d, t))
            d, t = d[order], t[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            d, t = d[new], t[new]
            times = np.diff(_runs(t))
            df = np.repeat(times, times)
            d, t, df = d[df > 1], t[df > 1], np.minimum(df[df > 1], 65535).astype("<u2")
            home = _home(d, n)
            order = np.lexsort((d, home))
            home, d, t, df = home[order], d[order], t[order], df[order]
            out, cuts = [], _runs(home)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = _runs(d[a:b])
                counts = np.concatenate([np.diff(own), [number[label]]]).astype("<u4")  # the bucket goes last
                out.append((labels[home[a]], _HASHES, _packed_docs(d[a:b][own[:-1]]), counts.tobytes(), t[a:b].tobytes(), df[a:b].tobytes()))
            if out:
                yield to_batch(out, _BLOCKS)

    return count


_NODES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("size", pa.int64()), ("hashes", pa.binary())])
_NODES_DDL = "node long, n long, prefix array<long>, size long, hashes binary"


def _prefix_size(n: np.ndarray, part: int, whole: int) -> np.ndarray:
    return n - -(-part * n // whole) + 1


def _candidates(part: int, whole: int):
    """Document side: sets whose prefix has shared hashes; hashes are in order of frequency."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            size_of: list[tuple[np.ndarray, np.ndarray]] = []
            docs, keys, weights = [], [], []
            for row in rows:
                own = _unpacked_docs(row[2])
                counts = np.frombuffer(row[3], "<u4").astype(np.int64)
                if row[1] == _SIZES:
                    size_of.append((own, counts))
                else:
                    docs.append(np.repeat(own, counts[:-1]))
                    keys.append((np.int64(counts[-1]) << np.int64(32)) | np.frombuffer(row[4], "<u4").astype(np.int64))
                    weights.append(np.frombuffer(row[5], "<u2"))
            if not docs:
                continue
            ids, at = np.unique(np.concatenate([a for a, _ in size_of]), return_index=True)
            sizes = np.concatenate([b for _, b in size_of])[at]
            d, key, weight = np.concatenate(docs), np.concatenate(keys), np.concatenate(weights)
            del docs, keys, weights
            order = np.lexsort((key, weight, d))
            d, key = d[order], key[order]
            cuts = _runs(d)
            n = sizes[np.searchsorted(ids, d[cuts[:-1]])]
            shared = np.diff(cuts)
            need = np.minimum(_prefix_size(n, part, whole) - (n - shared), shared)
            out, size = [], 0
            for i in np.flatnonzero(need > 0).tolist():
                own = key[cuts[i] : cuts[i + 1]]
                out.append((int(d[cuts[i]]), int(n[i]), own[: need[i]], 8 * len(own), own.astype("<i8").tobytes()))
                size += 8 * len(own)
                if size > 4 << 20:
                    yield to_batch(out, _NODES)
                    out, size = [], 0
            if out:
                yield to_batch(out, _NODES)

    return choose


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class PositionIndex:
    """Lists of pivots by hash, each in blocks of neighbouring positions."""

    WIDTH = 32
    #: Entries from which a block is looked through as an array.
    MANY = 24

    def __init__(self, least: float) -> None:
        self.lists: dict[int, dict[int, list]] = defaultdict(dict)
        self.share = least / (1 + least)
        self.least = least
        self.pivots = 0

    def add(self, pivot: int, hashes: list[int], first: int, n: int) -> None:
        self.pivots += 1
        for k, h in enumerate(hashes):
            position = first + k
            block = self.lists[h].setdefault(position // self.WIDTH, [0, n, array("q"), array("q"), array("q")])
            block[0] = max(block[0], n - position)
            block[1] = min(block[1], n)
            for column, value in zip(block[2:], (pivot, n - position, n), strict=True):
                column.append(value)

    def probe(self, hashes: list[int], first: int, n: int) -> set[int]:
        """Pivots that can still have the least similarity by position and size."""
        found: set[int] = set()
        share, low, high = self.share, self.least * n - 1e-9, n / self.least + 1e-9
        for k, h in enumerate(hashes):
            blocks = self.lists.get(h)
            if blocks is None:
                continue
            if len(found) == self.pivots:
                break  # all are candidates already
            left = n - first - k
            for rest, smallest, pivots, lefts, sizes in blocks.values():
                if min(left, rest) < share * (n + max(smallest, low)) - 1e-9:
                    continue  # no entry of the block can reach the overlap
                if len(pivots) < self.MANY:
                    for pivot, own_left, m in zip(pivots, lefts, sizes, strict=True):
                        if low <= m <= high and min(left, own_left) >= share * (n + m) - 1e-9:
                            found.add(pivot)
                else:
                    m = np.frombuffer(sizes, np.int64)
                    fits = (m >= low) & (m <= high) & (np.minimum(np.frombuffer(lefts, np.int64), left) >= share * (n + m) - 1e-9)
                    found.update(np.frombuffer(pivots, np.int64)[fits].tolist())
        return found


class Overlaps:
    """Intersections of one set with all sets at once, by counting along the lists of its hashes."""

    def __init__(self, ranked: list[np.ndarray]) -> None:
        self.ranked = ranked
        flat = np.concatenate(ranked)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(ranked)), [len(r) for r in ranked])[order]
        self.hashes, self.begin = np.unique(flat[order], return_index=True)
        self.length = np.diff(np.append(self.begin, len(flat)))

    def of(self, x: int) -> np.ndarray:
        at = np.searchsorted(self.hashes, self.ranked[x])
        length = self.length[at]
        skip = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        return np.bincount(self.owner[skip + np.arange(len(skip))], minlength=len(self.ranked))


def join_sets(sets: list[np.ndarray], sizes: list[int], part: int = PART, whole: int = WHOLE, near: float = NEAR) -> list[int]:
    """The smallest position linked with each position, over one or more links.

    sets hold hashes that at least two sets of the corpus share, the rarest first; sizes count all.
    """
    order = sorted(range(len(sets)), key=lambda i: sizes[i])
    ranked = [np.sort(s) for s in sets]
    every: list[Overlaps] = []  # made when first needed
    size_of = np.array(sizes)
    forest = Forest(len(sets))
    far = 1 - part / whole
    near = min(near, far)  # else two sets of a cluster can link while neither links with the pivot
    least = max(0.01, 1 - (far + 2 * near))
    index = PositionIndex(least)
    members: dict[int, list[tuple[float, int]]] = {}
    between: list[tuple[int, int, float]] = []

    def overlaps(x: int) -> np.ndarray:
        if not every:
            every.append(Overlaps(ranked))
        return every[0].of(x)

    for x in order:
        n = sizes[x]
        own_only = n - len(sets[x])
        take = max(0, n - int(np.ceil(least * n - 1e-9)) + 1 - own_only)
        hashes = sets[x][:take].tolist()
        pivots = sorted(index.probe(hashes, own_only, n))
        if len(pivots) > 16:
            both = overlaps(x)[pivots].tolist()
        else:
            both = [len(np.intersect1d(ranked[x], ranked[p], assume_unique=True)) for p in pivots]
        best, nearest, seen = 2.0, -1, []
        for p, common in zip(pivots, both, strict=True):
            union = n + sizes[p] - common
            distance = 1 - common / union
            if whole * common >= part * union:
                forest.join(x, p)
            seen.append((p, distance))
            if distance < best:
                best, nearest = distance, p
        if best <= near + 1e-12:
            members[nearest].append((best, x))
        else:
            members[x] = [(0.0, x)]
            between += [(p, x, distance) for p, distance in seen]
            index.add(x, hashes, own_only, n)
    radius = {p: max(m)[0] for p, m in members.items()}
    # clusters that the distances leave open; the smaller of two is looked through, and a set but once
    settled = np.zeros(len(sets), bool)
    for p, q, distance in between:
        if distance > far + radius[p] + radius[q] + 1e-9 or forest.root(p) == forest.root(q):
            continue
        few, many = sorted((members[p], members[q]), key=len)
        reach = max(many)[0]
        for d, x in sorted(few, reverse=True):
            if distance > far + d + reach + 1e-9:
                break  # this one, and those nearer to their pivot, are too far from all of the others
            if settled[x]:
                continue
            settled[x] = True
            both = overlaps(x)
            linked = whole * both >= part * (sizes[x] + size_of - both)
            for y in np.flatnonzero(linked & (both > 0)).tolist():
                forest.join(x, y)
            if forest.root(p) == forest.root(q):
                break
    return [forest.root(i) for i in range(len(sets))]


_ROOTS = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _joined(part: int, whole: int, keys: int):
    """Rows (keys, node, n, hashes) in order of their keys: each set of a group with the smallest it is linked with."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[:keys]):
            group = sorted((r[keys:] for r in rows), key=lambda r: r[0])
            if len(group) > 1:
                roots = join_sets([np.frombuffer(r[2], "<i8") for r in group], [r[1] for r in group], part, whole)
                yield to_batch([(r[0], group[k][0]) for r, k in zip(group, roots, strict=True)], _ROOTS)

    return join


_MET = pa.schema([("lead", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("linked", pa.bool_()), ("open", pa.bool_())])
_MET_DDL = "lead long, node long, size long, linked boolean, open boolean"


def _met(part: int, whole: int):
    """Rows (lead, block, own, star, node, n, hashes), by lead and block, the lead's own first in a block of a large lead.

    Gives links within the groups of small leads (the smallest set linked with stands as lead), and for each
    set of a large one how near it is to its lead (size is set there alone).
    """
    far = 1 - part / whole

    def stars(rows: Iterator[tuple]) -> Iterator[tuple]:
        lead, *_, n_lead, raw = next(rows)
        hashes = np.sort(np.frombuffer(raw, "<i8"))
        for *_, node, n, raw in rows:
            common = len(np.intersect1d(hashes, np.frombuffer(raw, "<i8"), assume_unique=True))
            union = n_lead + n - common
            linked = whole * common >= part * union
            yield lead, node, len(raw), linked, not linked and 1 - common / union <= 2 * far + 1e-9

    def group(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = sorted((r[4:] for r in rows), key=lambda r: r[0])
        roots = join_sets([np.frombuffer(r[2], "<i8") for r in own], [r[1] for r in own], part, whole)
        for r, k in zip(own, roots, strict=True):
            if r[0] != own[k][0]:
                yield own[k][0], r[0], None, True, False

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (_, _, star), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1], r[3])):
                yield from (stars if star else group)(rows)

        yield from by_bytes(found(), _MET, lambda r: 40)

    return meet


def _blocks(column: str, block_bytes: int):
    """In how many blocks the sets go whose bytes the column sums."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(column), F.lit(0)) / F.lit(block_bytes))).cast("int")


def _links(spark: SparkSession, nodes: DataFrame, part: int, whole: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between sets, enough to connect all that link; nodes has node, n, prefix, size, hashes."""
    entries = nodes.select("node", "size", F.explode("prefix").alias("hash"))
    leads = entries.groupBy("hash").agg(F.min("node").alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    leads = written(spark, leads, "firsts")
    total = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    # where sets go is settled on narrow rows; the hashes then move once for each lead
    places = written(spark, join_frequent(entries, leads, ["hash"], "rows", total).select("lead", "node", "size").distinct(), "places")
    big = places.groupBy("lead").agg(F.sum("size").alias("size")).where(F.col("size") > block_bytes).select("lead", _blocks("size", block_bytes).alias("blocks"))
    big = written(spark, big, "leads")
    sets = nodes.select("node", "n", "hashes")
    star = F.col("blocks").isNotNull()
    others = places.join(big, "lead", "left").where(~star | (F.col("node") != F.col("lead")))
    others = others.select("lead", F.when(star, F.pmod(F.hash("node"), "blocks")).otherwise(0).alias("block"), F.lit(False).alias("own"), star.alias("star"), "node")
    own = big.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("own"), F.lit(True).alias("star"), F.col("lead").alias("node"))
    rows = places.count() + own.count()
    dealt = sets.join(_small(others.unionByName(own), rows), "node").select("lead", "block", "own", "star", "node", "n", "hashes")
    met = dealt.repartition("lead", "block").sortWithinPartitions("lead", "block", F.desc("own")).mapInArrow(_met(part, whole), _MET_DDL)
    met = written(spark, met, "met")
    links = met.where("linked").select(F.col("node").alias("a"), F.col("lead").alias("b"))

    stars = met.where("size is not null")
    loads = stars.groupBy("lead").agg(F.sum(F.when(~F.col("linked"), F.col("size"))).alias("rest"), F.sum(F.when(F.col("linked"), F.col("size"))).alias("near"), F.max("open").alias("any"))
    loads = loads.where("rest is not null").select("lead", "any", _blocks("rest", block_bytes).alias("r"), _blocks("near", block_bytes).alias("m"))
    loads = written(spark, loads, "loads")
    if loads.isEmpty():
        return links
    held = stars.join(loads, "lead")
    mine = F.pmod(F.hash("node"), F.when(F.col("linked"), F.col("m")).otherwise(F.col("r")))
    among = held.where("not linked").select("lead", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("other"))
    among = among.select("lead", F.lit(0).alias("kind"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node")
    across = held.where("any and (linked or open)")
    over = F.explode(F.sequence(F.lit(0), F.when(F.col("linked"), F.col("r")).otherwise(F.col("m")) - 1)).alias("other")
    across = across.select("lead", "node", "linked", mine.alias("mine"), over)
    across = across.select("lead", F.lit(1).alias("kind"), F.when(F.col("linked"), F.col("mine")).otherwise(F.col("other")).alias("low"), F.when(F.col("linked"), F.col("other")).otherwise(F.col("mine")).alias("high"), "node")
    keys = ["lead", "kind", "low", "high"]
    again = written(spark, among.unionByName(across).select(*keys, "node"), "tasks")
    pairs = sets.join(_small(again, again.count()), "node").select(*keys, "node", "n", "hashes").repartition(*keys).sortWithinPartitions(*keys)
    pairs = pairs.mapInArrow(_joined(part, whole, len(keys)), "node long, root long").where("node <> root")
    return links.unionByName(pairs.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Narrow rows, marked for broadcast where they are few; the join is by shuffle where they are more."""
    return F.broadcast(rows) if n <= FEW_ROWS else rows


def _labels(spark: SparkSession, n: int) -> list[int]:
    """A label for each of n shuffle partitions that hash partitioning sends there, and nowhere else."""
    dealt = spark.range(0, 40 * n, 1, 1).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(n)).alias("p"))
    return sorted(r[0] for r in dealt.groupBy("p").agg(F.min("label")).select("min(label)").collect())


def link_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, whole: int = WHOLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    shared_dir(spark)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = every.where("doc_id is not null")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, sizes, one, two in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "n", "one", "two"])

    sets = written(spark, every.mapInArrow(digest, "doc_id long, n long, one long, two long"), "sets")
    total, hashes = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    key = ["n", "one", "two"]
    full = sets.where("n > 0 and doc_id is not null")
    classes = written(spark, full.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "classes")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes * HASH_BYTES // BUCKET_BYTES))
    labels = _labels(spark, buckets)
    blocks = rows.mapInArrow(_to_buckets(labels), _BLOCKS_DDL)
    shared = blocks.repartition(buckets, "label").sortWithinPartitions("label").mapInArrow(_shared_hashes(labels), _BLOCKS_DDL)
    nodes = shared.repartition(buckets, "label").sortWithinPartitions("label").mapInArrow(_candidates(part, whole), _NODES_DDL)
    nodes = written(spark, nodes, "nodes")

    linked = components(spark, _links(spark, nodes, part, whole, block_bytes))
    # copies across map tasks are nodes of their own; by class they come together
    of_class = linked.join(full.withColumnRenamed("doc_id", "node"), "node").join(classes, key).select("class_id", "comp").distinct()
    lows = of_class.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = of_class.join(lows, "comp").groupBy("class_id").agg(F.min("component_id").alias("component_id"))
    settled = classes.join(named, "class_id", "left").select(*key, "rows", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    found = join_frequent(full, settled, key, "rows", total).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that with the smallest id; all columns stay."""
    gone = link_components(spark, docs, id_col, text_col, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == gone["__gone"], "left_anti")
