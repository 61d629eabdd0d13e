"""Held-out splits and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, expected: int) -> DataFrame:
    """All of ``rows`` if there are no more than ``expected``, else about so many, picked by a hash of doc_id."""
    n = rows.count()
    if n <= expected:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(expected / n * (1 << 30)))
