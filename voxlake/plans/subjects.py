"""The subject table: names and channel that follow from a specimen's id, beside its thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of ids that mark the first channel, the longest first.
SUFFIXES = ("oldBlaze", "Blaze")


def subjects(table: DataFrame, id_col: str = "subject_id", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """table with short_id, the id without its ending, and channel: 0 for ids with one, else 1."""
    subject = F.col(id_col)
    short, channel = subject, F.lit(1)
    for s in reversed(suffixes):
        ends = F.endswith(subject, F.lit(s))
        short = F.when(ends, subject.substr(F.lit(1), F.length(subject) - len(s))).otherwise(short)
        channel = F.when(ends, 0).otherwise(channel)
    return table.withColumns({"short_id": short, "channel": channel})


def subject(table: DataFrame, subject_id: str, id_col: str = "subject_id") -> dict:
    """One subject's row; KeyError if the table has none of that id."""
    row = subjects(table, id_col).where(F.col(id_col) == subject_id).first()
    if row is None:
        raise KeyError(subject_id)
    return row.asDict()
