"""Secret scanning by dictionary-primed compression novelty.

Three patterns give the base spans: assignments to secret-like names, access key ids, and long runs
of hexadecimal digits. The method adds spans of kind "novel": a string close behind a sensitive word, or
in a base span, is compressed by zstandard with a raw-content dictionary of common identifiers and
the text around it. Its marginal compressed bytes, those of lead and string less those of the lead alone,
measure what neither code nor identifiers explain; strings that cost at least NOVEL of their own
length are incompressible and are reported, whatever characters they hold. All strings that begin within
REACH behind a sensitive word are measured. A plain word that the dictionary does not know, of 12 letters
or more, costs as much as letters drawn at random and is reported as well.

Positions are code points, ends exclusive. Spans come sorted by start, then by kind in the order of
KINDS, so repeated finds have a fixed order.

Edge cases: null and empty texts have no spans. Repeated rows are scanned each. Very long texts are
scanned whole; the dictionary never holds more than a fixed stretch around a candidate. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes

KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_NOVEL = 12, 18, 16, 12
#: Marginal compressed bytes, as a share of its length, from which a string is novel.
NOVEL = 0.75
#: Code points behind a sensitive word in which a string may begin, and around it for the dictionary.
REACH, BEFORE, AFTER, LEAD = 48, 512, 256, 8

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the whole of each run, as the pattern without a bound finds it
_SENSITIVE = re.compile(r"(?i:passw|passwd|pwd|secret|token|api_?key|access_?key|private_?key|auth|credential|bearer)", re.ASCII)
_STRING = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")  # an equals sign parts a name from its value, but for padding
_ASSIGNED_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE_WORDS = (*_ASSIGNED_WORDS, "passw", "pwd", "accesskey", "access_key", "privatekey", "private_key", "auth", "credential", "bearer")

#: Identifiers and phrases of code that say nothing new.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential "
    "username user_name session_id request response config settings environment variable default example placeholder "
    "changeme your_password your_token_here insert_key_here localhost 127.0.0.1 http://www.example.com https:// "
    "function return import export const static public private class String string boolean integer number null true false "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000000000000000 "
    "application/json Content-Type text/plain charset=utf-8 SELECT FROM WHERE INSERT INTO VALUES "
    "_for_production _for_development _for_testing _for_staging production-environment development-environment administrator "
    "authentication authenticated authorizations organisation organization international information applications implementation "
    "documentation infrastructure responsibility representation configurations communication communications distribution description "
    "certificate certificates permissions subscription transaction registration verification notification identification encryption "
    "management department government professional traditional additional conditional relationship understanding independent "
    "particularly approximately unfortunately immediately respectively significantly specifically automatically "
    "circumstances consideration investigation recommendation transformation characteristics opportunities manufacturing "
    "intelligence conversation construction concentration contribution introduction interpretation "
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    novelty: float | None


def base_spans(text: str, lower: str) -> list[tuple[str, int, int]]:
    found = []
    if any(w in lower for w in _ASSIGNED_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end] over its own bytes."""
    string = text[start:end].encode("utf-8", "surrogatepass")
    around = text[end : end + AFTER] + "\n" + text[max(0, start - BEFORE) : start]
    around = around.replace(text[start:end], "")  # another copy of it explains nothing
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_dict_id=False).compress
    lead = text[max(0, start - LEAD) : start].encode("utf-8", "surrogatepass")
    return (len(compress(lead + string)) - len(compress(lead))) / len(string)


def candidates(text: str, lower: str, base: list[tuple[str, int, int]]) -> set[tuple[int, int]]:
    """Strings in a sensitive context: in a base span, or beginning close behind a sensitive word."""
    found: set[tuple[int, int]] = set()
    for _, start, end in base:
        for m in _STRING.finditer(text, start, end):
            found.add(m.span())
    if any(w in lower for w in _SENSITIVE_WORDS):
        for m in _SENSITIVE.finditer(text):
            at, stop = m.end(), m.end() + REACH + LEAST_NOVEL
            while near := _STRING.search(text, at, stop):
                span = _STRING.match(text, near.start()).span()
                found.add(span)
                at = span[1]
    return found


def scan(text: str | None) -> list[Span]:
    if not text:
        return []
    lower = text.lower()
    base = base_spans(text, lower)
    spans = [Span(*b, None) for b in base]
    for start, end in candidates(text, lower, base):
        if (n := novelty(text, start, end)) >= NOVEL:
            spans.append(Span("novel", start, end, n))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_FOUND = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("novelty", pa.list_(pa.float64()))])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, spans (kind, start, end, novelty), sorted."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    spans = scan(text.as_py())
                    yield doc_id, [s.kind for s in spans], [s.start for s in spans], [s.end for s in spans], [s.novelty for s in spans]

        yield from by_bytes(found(), _FOUND, lambda r: 64 + 40 * len(r[1]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(find, "doc_id long, kinds array<string>, starts array<long>, ends array<long>, novelty array<double>")
    zipped = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("novelty"))
    return out.select("doc_id", zipped.cast("array<struct<kind:string,start:bigint,end:bigint,novelty:double>>").alias("spans"))
