"""Paths with slice queries, such as volume?slices=[0:1, 3, -1:, ::2]."""

from __future__ import annotations

from urllib.parse import parse_qs, quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Index = int | slice


def split_query(path: str) -> tuple[str, tuple[Index, ...] | None]:
    """The path without its query, and the slices that the query names; None without a query."""
    base, mark, query = path.partition("?")
    if not mark:
        return path, None
    found = parse_qs(query).get("slices")
    if not found or not (found[0].startswith("[") and found[0].endswith("]")):
        raise ValueError(f"slices must stand in brackets: {query}")

    def index(part: str) -> Index:
        if ":" not in part:
            return int(part)
        return slice(*(int(x) if x.strip() else None for x in part.split(":")))

    return base, tuple(index(p) for p in found[0][1:-1].split(","))


def file_name(path: str) -> str:
    """The last component of a path, without its query."""
    return path.partition("?")[0].rstrip("/").rpartition("/")[2]


def encoded(path: str) -> str:
    """A path as one file name: everything but letters, digits and _.-~ percent-encoded."""
    return quote(path, safe="")


def encoded_column(path: Column) -> Column:
    """The same for a column; the engine's form encoding differs in three characters."""
    out = F.url_encode(path)
    for plain, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def file_name_column(path: Column) -> Column:
    base = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    return F.substring_index(base, "/", -1)


def resolved(index: slice, length: int) -> tuple[int, int, int]:
    """Start, stop and step of a slice on an axis of that length; steps are positive."""
    start, stop, step = index.indices(length)
    if step <= 0:
        raise ValueError("steps must be positive")
    return start, max(start, stop), step


def sliced(df: DataFrame, indices: tuple[Index, ...], shape: tuple[int, ...], axes: tuple[str, ...], rebase: bool = True) -> DataFrame:
    """Rows inside the slices; an integer drops its axis.

    The conditions are plain comparisons of stored columns, so a Parquet scan skips row groups by
    them. With rebase, coordinates count from the slice's start in its steps.
    """
    keep: list[Column] = []
    changed: dict[str, Column] = {}
    gone: list[str] = []
    for axis, index, length in zip(axes, indices, shape):
        c = F.col(axis)
        if isinstance(index, int):
            at = index + length if index < 0 else index
            if not 0 <= at < length:
                raise IndexError(f"{index} is outside axis {axis} of length {length}")
            keep.append(c == at)
            gone.append(axis)
            continue
        start, stop, step = resolved(index, length)
        if start > 0:
            keep.append(c >= start)
        if stop < length:
            keep.append(c < stop)
        if step > 1:
            keep.append((c - start) % step == 0)
        if rebase and (start or step > 1):
            changed[axis] = (c - start) / step if step > 1 else c - start
    for condition in keep:
        df = df.where(condition)
    return df.withColumns({k: v.cast("long") for k, v in changed.items()}).drop(*gone)
