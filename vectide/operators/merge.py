"""Upserts and deletes as operators on DataFrames: the last write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row per key, the greatest by `order`; aggregated before and after one shuffle, without a window's sort."""
    others = [c for c in rows.columns if c != key]
    pick = F.max_by(F.struct(*others), F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("last")
    return rows.groupBy(key).agg(pick).select(*[F.col(key) if c == key else F.col(f"last.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """old with the rows of new put in; old must have one row per key.  Only new is aggregated; old loses its replaced keys by an anti join."""
    latest = last_wins(new, key, order)
    return old.join(latest.select(key), key, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def delete(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among keys."""
    return rows.join(keys.select(key), key, "left_anti").select(*rows.columns)
