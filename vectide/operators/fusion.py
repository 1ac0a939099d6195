"""Weighted reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import check_top_k
from ..sources.files import shared_dir

RRF_K = 60


def ranked(rows: DataFrame, *order, key: str = "id") -> DataFrame:
    """(key, rank from 1) of a list already cut to its top; one task numbers these few rows."""
    return rows.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def ranked_all(rows: DataFrame, *order, key: str = "id") -> DataFrame:
    """(key, rank from 1) of a list of any length, which is sorted by ranges and written to the shared folder.

    A row's rank is its place in its part and the rows of the parts before; only these counts, one per part, are broadcast.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}"
    rows.orderBy(*order).select(key, F.monotonically_increasing_id().alias("__m")).write.parquet(path)
    laid = spark.read.parquet(path).select(key, F.shiftright("__m", 33).alias("__part"), F.col("__m").bitwiseAND((1 << 33) - 1).alias("__at"))
    counts = laid.groupBy("__part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    before = counts.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return laid.join(F.broadcast(before), "__part").select(key, (F.col("before") + F.col("__at") + 1).alias("rank"))


def rrf(first: DataFrame, second: DataFrame, alpha: float, top_k: int | None = None, key: str = "id", k: int = RRF_K) -> DataFrame:
    """(key, score) of what either of two lists (key, rank) has: alpha / (k + rank) + (1 - alpha) / (k + rank), best first, ties by key.

    A list that lacks a key adds nothing; alpha isn't checked.
    """

    def share(df: DataFrame, weight: float) -> DataFrame:
        return df.select(key, (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("part"))

    both = share(first, alpha).unionByName(share(second, 1.0 - alpha))
    fused = both.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key)
    return fused if top_k is None else fused.limit(check_top_k(top_k))
