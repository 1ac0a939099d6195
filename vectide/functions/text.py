"""Words of a text, as keyword search sees them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more, in order, with repeats; NULL for NULL."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: F.octet_length(t) > 1)


def query_tokens(text: str) -> list[str]:
    """tokens() of a known text, by the same expression over one row, so that queries and documents are split alike in every script."""
    return SparkSession.active().range(1).select(tokens(F.lit(text))).first()[0]
