"""Vector search: nearest rows to one query, with filters, and to many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance_to
from ..schema import check_top_k, metric_name
from .stream import nearest_of_blocks

#: Bytes of queries, with their nearest so far, that a task holds at most.
QUERY_BYTES = 32 << 20


def fetch_k(top_k: int) -> int:
    """How many candidates are fetched before a filter, or for fusion."""
    return max(10 * top_k, 100)


def nearest(rows: DataFrame, query: Sequence[float], top_k: int, metric: str = "cosine", vector: str = "vector", tie: str = "id") -> DataFrame:
    """The top_k rows nearest to query, with `score` (lower is nearer), in order; ties by `tie`.

    Every partition keeps its own top_k, so nothing but these is shuffled.
    """
    scored = rows.withColumn("score", distance_to(F.col(vector), query, metric))
    return scored.orderBy("score", tie).limit(check_top_k(top_k))


def nearest_filtered(rows: DataFrame, query: Sequence[float], top_k: int, keep: Column, metric: str = "cosine", vector: str = "vector", tie: str = "id", prefilter: bool = False) -> DataFrame:
    """nearest() among the rows that pass `keep`.

    By default the filter looks at the fetch_k(top_k) nearest rows only, and may
    leave fewer than top_k.  With prefilter it comes first, which is exact and
    lets the scan skip rows.
    """
    if prefilter:
        return nearest(rows.where(keep), query, top_k, metric, vector, tie)
    fetched = nearest(rows.withColumn("__keep", keep), query, fetch_k(check_top_k(top_k)), metric, vector, tie)
    return fetched.where("__keep").drop("__keep").orderBy("score", tie).limit(top_k)


def batch_nearest(rows: DataFrame, queries: DataFrame, top_k: int, metric: str = "cosine", row_id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_id, row id, score, rank from 1) of the top_k rows nearest to each query; ties by row id.

    Every pair is looked at.  Each task holds a block of the queries, past which all
    rows stream (see `stream`), so that only top_k rows a query are shuffled.
    Null vectors, of rows or queries, are left out.
    """
    k, metric = check_top_k(top_k), metric_name(metric)
    known = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("asked"), F.col(query_vector).cast("array<float>").alias("query"))
    some = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("row"), F.col(vector).cast("array<float>").alias("vector"), F.lit(0).alias("cell"))
    asked, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("query")), F.lit(0))).first()
    if not asked or not k:
        empty = rows.sparkSession.createDataFrame([], f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{row_id}` {dict(rows.dtypes)[row_id]}, score double")
        return empty.withColumn("rank", F.lit(0))
    near = nearest_of_blocks(some, known, k, metric, (asked, some.count()), (query_id, row_id, "score"), lambda n: queries_held(width, n))
    return ranked_by_query(near, k, query_id, row_id)


def queries_held(width: int, k: int) -> int:
    """How many queries of `width` components a task holds at most."""
    return max(1, QUERY_BYTES // (4 * max(1, width) + 16 * k))


def ranked_by_query(near: DataFrame, k: int, query_id: str, row_id: str) -> DataFrame:
    """With `rank`, the k least scores of each query; ties by row id."""
    order = Window.partitionBy(query_id).orderBy("score", row_id)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
