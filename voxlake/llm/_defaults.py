"""Parameters that the registered queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_tokenizer() -> str:
    """Where the public byte-level BPE lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(ids: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(F.col(ids).cast("string")) % folds
