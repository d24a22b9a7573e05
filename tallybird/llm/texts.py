"""Small columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_text(docs: DataFrame, text: str = "text") -> Column:
    """The text as string; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
