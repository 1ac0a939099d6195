"""Approximate nearest neighbours: rows parted by their nearest centroid, searches reading few parts.

Scores of the rows returned are exact; which rows are found is approximate.  The
number of parts read is fitted at build time to a recall that is asked for, as
a curve over how many rows are looked for, measured on rows of a sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import distances
from ..schema import check_top_k
from ..sources.files import Files
from .search import nearest, queries_held, ranked_by_query
from .stream import matrix, nearest_of_blocks, unit

#: Tables of fewer rows are searched exactly.
EXACT_BELOW = 100_000
#: Queries that a task holds at most.
BLOCK = 60_000


def _cluster(sample: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample, by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = _far(sample, centroids).argmin(1)
        for c in range(len(centroids)):
            members = sample[own == c]
            centroids[c] = members.mean(0) if len(members) else sample[rng.integers(len(sample))]
    return centroids


@dataclass(frozen=True)
class AnnIndex:
    """rows: the table with its column `cell`, parted by it; centroids; rows in each cell; (share of the rows looked for, cells to read), growing."""

    rows: DataFrame
    centroids: np.ndarray
    metric: str
    sizes: np.ndarray
    curve: list[tuple[float, int]]

    @staticmethod
    def write(rows: DataFrame, path: str, metric: str = "cosine", vector: str = "vector", cells: int | None = None, recall: float = 0.95, k: int = 10, sample: int = 20_000, seed: int = 17) -> None:
        """Clusters a sample of at most `sample` rows, assigns every row to a cell, and writes the table parted by cell.

        The curve of cells to read begins at the k nearest of the sample.
        """
        spark = rows.sparkSession
        total = rows.count()
        picked = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector, F.lit(seed))).limit(sample).toPandas()
        points = np.stack([np.asarray(v, np.float64) for v in picked[vector]])
        route = points if metric == "euclidean" else unit(points)
        cells = cells or max(1, min(4096, int(math.sqrt(max(1, total)))))
        centroids = _cluster(route, cells, seed)
        curve = _fit_probes(points, route, centroids, metric, recall, k)
        shipped = spark.sparkContext.broadcast((centroids, metric))
        names = rows.columns
        schema = rows.withColumn("cell", F.lit(0)).schema

        def assign(batches):
            centers, m = shipped.value
            for batch in batches:
                flat = np.zeros((batch.num_rows, centers.shape[1]))
                flat[:] = matrix(batch.column(names.index(vector))) if batch.num_rows - batch.column(names.index(vector)).null_count else 0
                own = _far(flat if m == "euclidean" else unit(flat), centers).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*names, "cell"])

        rows.mapInArrow(assign, schema).repartition("cell").write.partitionBy("cell").parquet(f"{path}/rows")
        sizes = np.zeros(len(centroids), np.int64)
        for cell, n in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(vector)).collect():
            sizes[cell] = n
        Files(spark).write(f"{path}/ann.json", json.dumps({"metric": metric, "sizes": sizes.tolist(), "curve": curve, "centroids": centroids.tolist()}))

    @staticmethod
    def open(spark: SparkSession, path: str) -> AnnIndex:
        meta = json.loads(Files(spark).read(f"{path}/ann.json"))
        return AnnIndex(spark.read.parquet(f"{path}/rows"), np.array(meta["centroids"]), meta["metric"], np.array(meta["sizes"]), [(share, n) for share, n in meta["curve"]])

    def least(self, top_k: int, probes: int | None = None) -> tuple[int, int]:
        """(cells, rows) that a search reads at the least: of rows twice top_k, should there be as many; probes, if given, decides alone."""
        if probes:
            return probes, 0
        total = int(self.sizes.sum())
        fitted = next((n for share, n in self.curve if share * total >= top_k), len(self.centroids))
        return fitted, min(total, 2 * top_k)

    def cells(self, query: Sequence[float], probes: int | None = None, top_k: int = 10) -> list[int]:
        order = _by_nearness(np.asarray([query], np.float64), self.centroids, self.metric)
        return order[0, : _reach(order, self.sizes, *self.least(top_k, probes))[0]].tolist()

    def search(self, query: Sequence[float], top_k: int, probes: int | None = None, vector: str = "vector", tie: str = "id") -> DataFrame:
        """nearest() among the rows of the cells nearest to query; other cells' files aren't read."""
        near = self.rows.where(F.col("cell").isin(self.cells(query, probes, top_k))).drop("cell")
        return nearest(near, query, top_k, self.metric, vector, tie)

    def batch_search(self, queries: DataFrame, top_k: int, probes: int | None = None, row_id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
        """(query_id, row id, score, rank from 1): search() for every row of queries; ties by row id.

        Each task holds a block of the queries, of BLOCK at most, and the cells stream
        past it (see `stream`): each meets the queries that read it, and only top_k
        rows a query are shuffled.  Null vectors are left out.
        """
        k, spark, metric = check_top_k(top_k), self.rows.sparkSession, self.metric
        known = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("asked"), F.col(query_vector).cast("array<float>").alias("query"))
        asked = known.count()
        if k == 0 or not asked:
            return spark.createDataFrame([], f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{row_id}` {dict(self.rows.dtypes)[row_id]}, score double").withColumn("rank", F.lit(0))
        shipped = spark.sparkContext.broadcast((self.centroids, self.sizes, self.least(k, probes)))

        def route(vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            centroids, sizes, least = shipped.value
            read = []
            for at in range(0, len(vectors), 1024):
                order = _by_nearness(vectors[at : at + 1024], centroids, metric, sizes, *least)
                one, place = np.nonzero(np.arange(order.shape[1]) < _reach(order, sizes, *least)[:, None])
                read.append((order[one, place].astype(np.int32), (one + at).astype(np.int32)))
            cell, one = (np.concatenate(x) for x in zip(*read, strict=True))
            by = np.argsort(cell, kind="stable")
            cell, one = cell[by], one[by]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            yield from zip(cell[first].tolist(), np.split(one, first[1:]), strict=True)

        rows = self.rows.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("row"), F.col(vector).cast("array<float>").alias("vector"), "cell")
        near = nearest_of_blocks(rows, known, k, metric, (asked, int(self.sizes.sum())), (query_id, row_id, "score"), lambda n: min(BLOCK, queries_held(self.centroids.shape[1], n)), route)
        return ranked_by_query(near, k, query_id, row_id)


def _far(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """What orders centroids by their Euclidean distance to each point: its square less the point's own."""
    return (centroids * centroids).sum(1) - 2.0 * (points @ centroids.T)


def _by_nearness(queries: np.ndarray, centroids: np.ndarray, metric: str, sizes: np.ndarray | None = None, cells: int = 0, rows: int = 0) -> np.ndarray:
    """The cells from the nearest on, for each query; with sizes, so many for all queries as are enough for _reach()."""
    route = np.asarray(queries, np.float64)
    far, n = _far(route if metric == "euclidean" else unit(route), centroids), max(2 * cells, 16)
    if sizes is None or n >= len(centroids):
        return np.argsort(far, axis=1, kind="stable")
    order = np.argpartition(far, n, axis=1)[:, :n]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), axis=1, kind="stable"), 1)
    return order if (sizes[order].sum(1) >= rows).all() else np.argsort(far, axis=1, kind="stable")


def _reach(order: np.ndarray, sizes: np.ndarray, cells: int, rows: int) -> np.ndarray:
    """How many of each query's cells, in their order, are read: `cells`, and on until they hold `rows`."""
    return np.clip((sizes[order].cumsum(1) < rows).sum(1) + 1, cells, order.shape[1]) if cells < order.shape[1] else np.full(len(order), order.shape[1])


def _fit_probes(points: np.ndarray, route: np.ndarray, centroids: np.ndarray, metric: str, recall: float, k: int) -> list[tuple[float, int]]:
    """For the sample's k, 2 k, 4 k ... nearest: (their share of it, cells to read so that `recall` of them are found for 200 of its points)."""
    own = _far(route, centroids)
    cell = own.argmin(1)
    asked = np.linspace(0, len(points) - 1, min(200, len(points))).astype(int)
    d = distances(points, points[asked], metric)
    near = np.argsort(d, axis=0)[1:].T
    rank = np.argsort(np.argsort(own[asked], axis=1), axis=1)
    needed = np.take_along_axis(rank, cell[near], axis=1) + 1
    curve, probes = [], 1
    while k <= near.shape[1]:
        found = np.bincount(needed[:, :k].ravel(), minlength=len(centroids) + 1).cumsum() / needed[:, :k].size
        probes = max(probes, int(np.searchsorted(found, recall)))
        curve.append((k / len(points), min(probes, len(centroids))))
        k *= 2
    return curve
