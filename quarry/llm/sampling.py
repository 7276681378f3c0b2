"""Bounded samples by hash, for models that are fitted on part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(wanted: int, total: int) -> int:
    """The signed 64-bit number that a share ``wanted / total`` of all 64-bit hashes lies below."""
    return (wanted << 64) // total - (1 << 63)


def sampled(rows: DataFrame, key: str, salt: str, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, told by a hash of ``key``; all where there are no more.

    The share is a fraction of the 64-bit hashes, so that it never rounds to nothing.  Rows of one key
    come together.
    """
    return rows if total <= wanted else rows.where(F.xxhash64(F.lit(salt), F.expr(key)) < F.lit(threshold(wanted, total)))
