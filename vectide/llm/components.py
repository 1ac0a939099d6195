"""Connected components of a graph of long node ids, each named by its least node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import written

#: Graphs of at most so many edges are joined in one task (some 100 MB); larger ones by rounds of shuffles.
ONE_TASK_EDGES = 2_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], lo)
        np.minimum.at(new, root[v], lo)
        np.minimum.at(new, u, lo)
        np.minimum.at(new, v, lo)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) of every node of edges (a, b: bigint); loops count as nodes; no edges give no rows."""
    edges = written(edges.select("a", "b"))
    if edges.count() <= one_task_edges:

        def one(batches):
            whole = [np.zeros((2, 0), np.int64), *[np.stack([x.column(c).to_numpy() for c in ("a", "b")]) for x in batches]]
            nodes, roots = union_find(*np.concatenate(whole, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

        return edges.coalesce(1).mapInArrow(one, "node bigint, root bigint")
    return _by_rounds(edges)


def _by_rounds(edges: DataFrame) -> DataFrame:
    """Alternates the large-star and small-star operations until the edges are stars around least nodes.

    Least neighbours are grouped, which merges before it shuffles, and joined
    back, which adaptive execution splits: a node with any number of neighbours is no task by itself.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u")).distinct()
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.union(now.where("u = v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = written(small.where("u > v").union(large.where("u = v")).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.union(stars.select("root", "root")).distinct().groupBy("node").agg(F.min("root").alias("root"))
        mark = tuple(found)
