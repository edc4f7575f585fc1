"""Harmonic packing of token sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds the lengths over capacity / (k + 1)
and up to capacity / k, and every bin of class k takes exactly k pieces, so a bin is placed by
counting alone and each worker fills its own bins. A document becomes its full sequences and a tail,
and a tail is cut into as few pieces as there can be when k pieces of a length, in a bin of their class,
leave at most waste tokens. With 1024 and 8 that is 2.5 pieces for a tail, on average over its lengths.

Each task numbers its own pieces. What does not fill a bin (fewer than k pieces per class and task)
is dealt anew over fewer workers, each taking a bounded number of leftover pieces, and so on until
one worker is left, so leftovers shrink geometrically. The last worker packs what remains, fewer
than k pieces a class, over all classes in decreasing order of length.

Texts never move: a piece is (document, start, length, checksum of its ids). The pieces are written
once to the shared folder, so nothing is tokenised twice and a lost executor costs only its part.

Token ids are those of the byte-level BPE in the given tokenizer file, plus the end id 0. With added_tokens, as
the queries have it, the file's added tokens are found in the texts as tokenizers does by default, and each is one
id; else they are cut into ordinary pieces, which is tokenizers with encode_special_tokens.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed each on their own. A
very long text becomes many full sequences. An empty table gives an empty result. Null ids are packed like
others. Columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, written

CAPACITY = 1024
END_ID = 0
WASTE = 8
#: Leftover pieces that one worker takes at a later level; far above the sum of all k.
LEFT_PER_WORKER = 200_000
#: Words whose ids a worker remembers at most.
REMEMBERED = 300_000

#: The pre-token pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GAPS = re.compile(r"\s\s|^\s|\s$")
_WORD_IDS = np.dtype("<u4")


class Encoder:
    """Whole texts to token ids as little-endian unsigned 32-bit bytes, remembering words.

    A space before a non-space, and a line end between two non-spaces, always begin a new
    pre-token of the byte-level pattern, so texts without double or outer white space can be
    encoded word by word with the same result. Other texts are encoded at once. With added_tokens,
    texts are first split at the longest added tokens from the left, and what lies between is encoded
    on its own; files whose added tokens take in more than their content leave such texts to tokenizers.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        # printable stand-ins of the byte-level alphabet
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._first: dict[str, bytes] = {}
        self._after: dict[str, bytes] = {}
        self._line_end = self._plain("\n")
        added = model.get("added_tokens", []) if added_tokens else []
        self._added = {t["content"]: np.array([t["id"]], _WORD_IDS).tobytes() for t in added}
        self._at_added = re.compile("(" + "|".join(re.escape(c) for c in sorted(self._added, key=len, reverse=True)) + ")")
        self._exact = None
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(path)

    def _plain(self, text: str) -> bytes:
        return np.array(self._encode(text), _WORD_IDS).tobytes()

    def _word(self, known: dict[str, bytes], word: str, before: str) -> bytes:
        if len(known) >= REMEMBERED:
            known.clear()
        out = self._plain(before + word)
        if len(word) < 64:
            known[word] = out
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in self._added):
            if self._exact:
                return np.array(self._exact.encode(text, add_special_tokens=False).ids, _WORD_IDS).tobytes()
            return b"".join(self._added[p] if p in self._added else self._between(p) for p in self._at_added.split(text))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        if _GAPS.search(text):
            return self._plain(text)
        first, after, word, lines = self._first, self._after, self._word, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts = [first.get(head) or word(first, head, "")]
            parts += [after.get(w) or word(after, w, " ") for w in rest]
            lines.append(b"".join(parts))
        return self._line_end.join(lines)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The reciprocal class of a length, and how many pieces a bin of that class takes."""
    return capacity // length


def tail_cuts(capacity: int = CAPACITY, waste: int = WASTE) -> list[list[int]]:
    """For each length under capacity, the fewest piece lengths, longest first, that sum to it.

    A length may be a piece if a bin of its class, filled with it alone, leaves at most waste tokens; one
    always may. Of several ways with as few pieces, that with the longest first piece is taken.
    """
    allowed = [n for n in range(capacity - 1, 0, -1) if capacity - class_of(n, capacity) * n <= waste]
    cuts: list[list[int]] = [[]]
    for total in range(1, capacity):
        best = min((len(cuts[total - n]), -n) for n in allowed if n <= total)
        cuts.append(sorted([-best[1], *cuts[total + best[1]]], reverse=True))
    return cuts


def cut(total: int, cuts: list[list[int]]) -> list[int]:
    """Piece lengths that sum to total: full sequences, then the tail's pieces."""
    full, tail = divmod(total, len(cuts))
    return [len(cuts)] * full + cuts[tail]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Filler:
    """Numbers pieces into the bins of one worker at one level; sequence ids never meet another's."""

    def __init__(self, level: int, group: int, capacity: int) -> None:
        self.base = (level << 59) | (group << 37)
        self.capacity, self.open, self.next = capacity, defaultdict(list), 0

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this one fills, if it does."""
        k = class_of(piece[2], self.capacity)
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        return self.sequence(held)

    def sequence(self, held: list[tuple]) -> list[tuple]:
        number, at, out = self.base | self.next, 0, []
        self.next += 1
        for p in held:
            out.append((*p[:5], number, at))
            at += p[2]
        return out

    def rest(self) -> Iterator[tuple]:
        for held in self.open.values():
            yield from held
        self.open.clear()

    def mixed(self) -> Iterator[tuple]:
        """The open pieces over all classes, first fit in falling order of length."""
        bins: list[tuple[int, list]] = []
        for p in sorted(self.rest(), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
            for i, (used, held) in enumerate(bins):
                if used + p[2] <= self.capacity:
                    held.append(p)
                    bins[i] = (used + p[2], held)
                    break
            else:
                bins.append((p[2], [p]))
        for _, held in bins:
            yield from self.sequence(held)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, waste: int = WASTE, added_tokens: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = tail_cuts(capacity, waste)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, filler = Encoder(tokenizer, added_tokens), _Filler(0, TaskContext.get().partitionId(), capacity)
        end = np.array([END_ID], _WORD_IDS).tobytes()

        def placed():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = memoryview(encode(text.as_py()) + end)
                    total, start = len(ids) // 4, 0
                    for length in cut(total, cuts):
                        piece = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, None, None)
                        start += length
                        yield from filler.add(piece)
            yield from filler.rest()

        yield from by_bytes(placed(), PIECES, lambda r: 56)

    def later_level(level: int, last: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            filler = _Filler(level, TaskContext.get().partitionId(), capacity)

            def placed():
                for batch in batches:
                    for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        yield from filler.add(piece)
                yield from filler.mixed() if last else filler.rest()

            yield from by_bytes(placed(), PIECES, lambda r: 56)

        return place

    table = written(spark, rows.mapInArrow(first_level, PIECES_DDL), "pieces")
    result, left, level = table.where("sequence_id is not null"), table.where("sequence_id is null"), 0
    per_worker = max(LEFT_PER_WORKER, 4 * sum({class_of(n, capacity) for own in cuts for n in own}))  # a worker leaves less than a quarter of what it takes
    while True:
        level, workers = level + 1, -(-left.count() // per_worker)
        placed = left.coalesce(max(1, workers)).mapInArrow(later_level(level, workers <= 1), PIECES_DDL)
        table = written(spark, placed, "pieces")
        result, left = result.unionAll(table.where("sequence_id is not null")), table.where("sequence_id is null")
        if workers <= 1:
            return result
