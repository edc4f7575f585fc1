"""Ordered keyed collections and set operations on rows.

A collection is a relation (pos, k, v): pos is the order of the keys, counted from 0 without gaps.
Dictionaries of columns are DataFrames themselves, so their operators are on columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def setdiff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b does not have."""
    return a.subtract(b)


def unique_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of some columns, of any type, and how often each stands."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def unique_with_inverse(df: DataFrame, column: str) -> DataFrame:
    """df with inverse, the rank from 0 of each row's value among the distinct values."""
    from voxlake.operators.labels import dense_ids

    return df.join(dense_ids(df.select(column), column), column).withColumn("inverse", F.col("dense") - 1).drop("dense")


def common_keys(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Entries of the first collection whose keys all others have, in the first one's order."""
    out = first
    for other in others:
        out = out.join(other.select("k").distinct(), "k", "left_semi")
    return out


def put(entries: DataFrame, key: str, value: object) -> DataFrame:
    """A new key goes to the end; a known one keeps its place."""
    known = entries.where(F.col("k") == key)
    if known.isEmpty():
        end = entries.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).cast("int").alias("pos"))
        kind = dict(entries.dtypes)["v"]
        return entries.unionByName(end.select(F.col("pos").cast(dict(entries.dtypes)["pos"]), F.lit(key).alias("k"), F.lit(value).cast(kind).alias("v")))
    return entries.withColumn("v", F.when(F.col("k") == key, F.lit(value)).otherwise(F.col("v")))


def remove(entries: DataFrame, key: str) -> DataFrame:
    """Without a key, which must be there; later keys move up."""
    found = entries.where(F.col("k") == key).select("pos").first()
    if found is None:
        raise KeyError(key)
    return entries.where(F.col("k") != key).withColumn("pos", F.when(F.col("pos") > found.pos, F.col("pos") - 1).otherwise(F.col("pos")))


def pop(entries: DataFrame, key: str, default: object = KeyError) -> tuple[DataFrame, object]:
    """The entries without a key, and its value; without the key, the same entries and the default, if one is given."""
    found = entries.where(F.col("k") == key).select("v").first()
    if found is None:
        if default is KeyError:
            raise KeyError(key)
        return entries, default
    return remove(entries, key), found.v


def clear(entries: DataFrame) -> DataFrame:
    """No entries, of the same columns."""
    return entries.where(F.lit(False))


def ordered(entries: DataFrame) -> DataFrame:
    """Entries in the order of their keys."""
    return entries.orderBy("pos")


def key_at(entries: DataFrame, i: int) -> str:
    """The key at a place; negative places count from the end."""
    place = F.lit(i) if i >= 0 else entries.count() + i
    found = entries.where(F.col("pos") == place).select("k").first()
    if found is None:
        raise IndexError(i)
    return found.k


def first_rows(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n first rows in the order of some columns: a top-k, without a full sort."""
    return df.orderBy(*by).limit(n)


def rename(entries: DataFrame, old: str, new: str) -> DataFrame:
    """A key's new name in its old place; the new name must be free."""
    if not entries.where(F.col("k") == new).isEmpty():
        raise KeyError(f"{new} exists")
    if entries.where(F.col("k") == old).isEmpty():
        raise KeyError(old)
    return entries.withColumn("k", F.when(F.col("k") == old, F.lit(new)).otherwise(F.col("k")))


def reorder(entries: DataFrame, keys: list[str]) -> DataFrame:
    """All entries in the order of keys, which must be exactly theirs."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("k")) - 1
    counts = entries.agg(F.count("*").alias("n"), F.count_if(F.col("k").isin(keys)).alias("named")).first()
    if not len(set(keys)) == len(keys) == counts.n == counts.named:
        raise KeyError(f"{len(set(keys))} keys, {counts.n} entries, {counts.named} of them named")
    return entries.withColumn("pos", place.cast(dict(entries.dtypes)["pos"]))


def subset(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The named entries in the order of keys."""
    wanted = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    out = entries.where(F.array_contains(wanted, F.col("k")))
    if out.count() != len(keys):
        raise KeyError("some keys are missing")
    return out.withColumn("pos", (F.array_position(wanted, F.col("k")) - 1).cast(dict(entries.dtypes)["pos"]))


def trim_keys(entries: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Keys without a prefix and a suffix that all of them must have."""
    n, m = len(prefix), len(suffix)
    bad = ~(F.startswith("k", F.lit(prefix)) & F.endswith("k", F.lit(suffix)) & (F.length("k") >= n + m))
    if not entries.where(bad).isEmpty():
        raise ValueError("a key lacks the prefix or suffix")
    return entries.withColumn("k", F.col("k").substr(F.lit(n + 1), F.length("k") - n - m))


def common_affixes(entries: DataFrame) -> tuple[str, str]:
    """The longest prefix and the longest suffix that all keys share; they follow from two extreme keys each."""

    def shared(a: str, b: str) -> str:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return a[:k]

    r = entries.agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min(F.reverse("k")).alias("c"), F.max(F.reverse("k")).alias("d")).first()
    if r.a is None:
        return "", ""
    prefix, suffix = shared(r.a, r.b), shared(r.c, r.d)[::-1]
    shortest = entries.agg(F.min(F.length("k"))).first()[0]
    return prefix, suffix[max(0, len(prefix) + len(suffix) - shortest) :]


def trim_common(entries: DataFrame) -> DataFrame:
    return trim_keys(entries, *common_affixes(entries))


def add_columns(a: DataFrame, columns: dict, overlap: bool = False) -> DataFrame:
    """Columns of a and new ones; names may only meet with overlap, then the new ones win."""
    if not overlap and (both := set(a.columns) & set(columns)):
        raise KeyError(f"columns exist: {sorted(both)}")
    return a.withColumns(columns)


def keep_columns(a: DataFrame, names: list[str]) -> DataFrame:
    return a.select(*names)


def drop_columns(a: DataFrame, names: list[str], missing: bool = False) -> DataFrame:
    if not missing and (absent := set(names) - set(a.columns)):
        raise KeyError(f"no columns {sorted(absent)}")
    return a.drop(*names)
