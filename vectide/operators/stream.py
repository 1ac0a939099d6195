"""Many queries at once: a task holds a block of queries, and the rows stream past it in chunks.

Nothing goes through the driver or is broadcast but what routes queries to
cells; a task's memory depends on its queries and one chunk, not on how many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import pair_distances, squares

#: Rows of a chunk, and its bytes, at most; queries that meet it in one product; pairs whose distances are computed at once.
CHUNK, CHUNK_BYTES, TILE, PAIRS = 4096, 1 << 20, 512, 1 << 15
#: Stands for a distance that is no number, behind all others.
_NONE = np.finfo(np.float64).max


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column, null ones as zeros."""
    some = vectors.drop_null()
    flat = some.flatten().to_numpy(zero_copy_only=False)
    if len(some) == len(vectors):
        return flat.reshape(len(vectors), -1)
    out = np.zeros((len(vectors), len(flat) // max(1, len(some))), flat.dtype)
    out[vectors.is_valid().to_numpy(zero_copy_only=False)] = flat.reshape(len(some), -1) if len(some) else 0
    return out


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _screen(q: np.ndarray, v: np.ndarray, far: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, least, margin): a row at distance `far` or nearer has a product a @ b.T, in 32 bits, of at least `least` - `margin`.

    Products are of vectors of length 1 and 1.5 at most, so that rounding adds
    no more than their number of components times 2**-24, and margins are four times that.
    """
    margin = np.full(len(q), 4.0 * (q.shape[1] + 4) * 2.0**-24)
    with np.errstate(all="ignore"):
        if metric == "cosine":
            return unit(q), unit(v), 1.0 - far, margin
        own, top = np.sqrt((q * q).sum(1)), float(np.sqrt((v * v).sum(1)).max()) or 1.0
        if metric == "dot":
            return unit(q), v / top, np.where(own > 0, -far / (np.where(own > 0, own, 1.0) * top), np.where(far < 0, 1.0, -1.0)), margin
        a = np.column_stack([2.0 * q, np.full(len(q), -top)])
        length = np.sqrt((a * a).sum(1))
        b = v / top
        return a / length[:, None], np.column_stack([b, (b * b).sum(1)]), (own * own - far * far) / (top * length), margin + 1e-15 * own / top


class Nearest:
    """The k nearest rows so far of each of a block's queries; ties by `order`, a number of each row.

    32-bit products tell which rows may be near enough; distances of these are
    computed one by one in 64 bits, alike wherever a pair comes up.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.d = np.full((len(queries), k), np.inf)
        self.order = np.full((len(queries), k), -1, np.int64)
        self.known: list[tuple[np.ndarray, pa.Array]] = []
        self.size = self.bound = 0

    def meet(self, asked: np.ndarray, v: np.ndarray, order: np.ndarray, ids: pa.Array) -> None:
        """asked: which of the queries these rows are for."""
        v, entered = v.astype(np.float64), np.zeros(len(v), bool)
        sums = squares(v)
        for at in range(0, len(asked), TILE):
            tile = asked[at : at + TILE]
            q, far = self.q[tile].astype(np.float64), self.d[tile, -1]
            a, b, least, margin = _screen(q, v, far, self.metric)
            with np.errstate(all="ignore"):
                products = a.astype(np.float32) @ b.astype(np.float32).T
            new = np.flatnonzero(np.isinf(far))
            if len(new) and len(v) > self.k:
                least[new] = np.partition(products[new], len(v) - self.k, axis=1)[:, len(v) - self.k] - margin[new]
            near = np.flatnonzero(~(products < (least - margin).astype(np.float32)[:, None]))
            q_sums = squares(q) if len(near) else None
            for lo in range(0, len(near), PAIRS):
                one, r = np.divmod(near[lo : lo + PAIRS], len(v))
                d = pair_distances(q[one], v[r], q_sums[one], sums[r], self.metric)
                d[np.isnan(d)] = _NONE
                entered[self._merge(tile, one, r, d, order)] = True
        if entered.any():
            self.known.append((order[entered], ids.filter(pa.array(entered))))
            self.size += int(entered.sum())
            if self.size > self.bound:
                self._forget()

    def _merge(self, tile: np.ndarray, one: np.ndarray, r: np.ndarray, d: np.ndarray, order: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(d <= self.d[tile[one], -1])
        one, r, d = one[some], r[some], d[some]
        by = np.lexsort((order[r], d, one))
        one, r, d = one[by], r[by], d[by]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        rank = np.arange(len(one)) - np.repeat(first, np.diff(first, append=len(one)))
        some = rank < self.k
        one, r, d, rank = one[some], r[some], d[some], rank[some]
        which, at = np.unique(one, return_inverse=True)
        own, width = tile[which], int(rank.max(initial=-1)) + 1
        more, places = np.full((len(which), width), np.inf), np.full((len(which), width), -1, np.int64)
        more[at, rank], places[at, rank] = d, order[r]
        more, places = np.hstack([self.d[own], more]), np.hstack([self.order[own], places])
        best = np.lexsort((places, more), axis=1)[:, : self.k]
        self.d[own], self.order[own] = np.take_along_axis(more, best, 1), np.take_along_axis(places, best, 1)
        return r

    def _forget(self) -> None:
        """Keeps the ids of rows that are still among the nearest of any query."""
        order = np.concatenate([o for o, _ in self.known])
        keep = np.isin(order, self.order)
        ids = pa.concat_arrays([i for _, i in self.known]).filter(pa.array(keep))
        self.known, self.size = [(order[keep], ids)], int(keep.sum())
        self.bound = 2 * self.size + (1 << 16)

    def found(self, which: np.ndarray) -> tuple[np.ndarray, pa.Array | None, np.ndarray]:
        """(position in which, row id, distance) of the rows found for these queries."""
        if len(self.known) > 1:
            self._forget()
        one, at = np.nonzero(self.order[which] >= 0)
        if not len(one):
            return one, None, np.zeros(0)
        order, ids = self.known[0]
        by = np.argsort(order, kind="stable")
        place = by[np.searchsorted(order[by], self.order[which[one], at])]
        d = self.d[which[one], at]
        return one, ids.take(pa.array(place)), np.where(d == _NONE, np.nan, d)


def nearest_of_blocks(rows: DataFrame, queries: DataFrame, k: int, metric: str, total: tuple[int, int], names: tuple[str, str, str], most: Callable[[int], int], route: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]] | None = None) -> DataFrame:
    """(query id, row id, score): each query's k nearest among the rows (row, vector, cell) that `route` names; ties by row.

    queries: (asked, query), no nulls; total: how many queries and rows; most(k): how
    many queries a task holds; route(vectors): (cell, places in vectors of the queries that read it), or None if all read all.
    """
    spark, k = rows.sparkSession, max(1, min(k, total[1]))
    types = [dict(queries.dtypes)["asked"], dict(rows.dtypes)["row"]]
    blocks = max(-(-total[0] // most(k)), min(2 * spark.sparkContext.defaultParallelism, -(-total[0] // 256)), 1)
    schema = f"cell int, asked array<{types[0]}>, row array<{types[1]}>, at binary, vectors binary"
    kinds = (rows.select(F.array("row")).limit(0).toArrow().schema.types[0], queries.select(F.array("asked")).limit(0).toArrow().schema.types[0])

    def pack(rows_side: bool):
        def run(batches):
            for batch in batches:
                v, cell = matrix(batch.column(1)).astype(np.float32), batch.column(2).to_numpy()
                size = max(1, min(CHUNK, CHUNK_BYTES // max(1, 4 * v.shape[1]))) if batch.num_rows else 1
                by = np.argsort(cell, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1) if len(by) else []:
                    for lo in range(0, len(part), size):
                        some = part[lo : lo + size]
                        ids, at = batch.column(0).take(pa.array(some)), batch.column(3).to_numpy()[some].tobytes() if rows_side else None
                        lists = [pa.nulls(1, kinds[1]), pa.array([ids], kinds[0])] if rows_side else [pa.array([ids], kinds[1]), pa.nulls(1, kinds[0])]
                        yield pa.RecordBatch.from_arrays([pa.array([cell[some[0]]], pa.int32()), *lists, pa.array([at], pa.binary()), pa.array([v[some].tobytes()], pa.binary())], names=["cell", "asked", "row", "at", "vectors"])

        return run

    def search(batches):
        asked, held, state, readers = [], [], None, {}

        def begin():
            q = np.concatenate(held)
            distinct, own = np.unique(np.ascontiguousarray(q).view(np.dtype((np.void, q.shape[1] * 4))).ravel(), return_inverse=True)
            q = np.ascontiguousarray(distinct).view(np.float32).reshape(len(distinct), -1)
            return Nearest(q, k, metric), own, {None: np.arange(len(q))} if route is None else dict(route(q))

        for batch in batches:
            for i in range(batch.num_rows):
                cell, v = batch.column(0)[i].as_py(), np.frombuffer(batch.column(4)[i].as_buffer(), np.float32)
                if cell < 0:
                    asked.append(batch.column(1)[i].values)
                    held.append(v.reshape(len(asked[-1]), -1).copy())
                    continue
                if not asked:
                    continue
                if state is None:
                    state, own, readers = begin()
                those = readers.get(cell if route is not None else None)
                if those is not None and len(those):
                    ids = batch.column(2)[i].values
                    state.meet(those, v.reshape(len(ids), -1), np.frombuffer(batch.column(3)[i].as_buffer(), np.int64), ids)
        if state is not None:
            ids = pa.concat_arrays(asked)
            for at in range(0, len(ids), 4096):
                one, found, d = state.found(own[at : at + 4096])
                if len(one):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(one + at)), found, pa.array(d)], names=list(names))

    placed = rows.orderBy("row").select("row", "vector", "cell", F.monotonically_increasing_id().alias("at"))
    if route is not None:
        placed = placed.repartition("cell").sortWithinPartitions("cell")
    every = placed.mapInArrow(pack(True), schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block: Column = F.pmod(F.xxhash64("asked"), F.lit(blocks))
    # A query's block, as -1 - block in the place of a cell, comes before all rows.
    split = queries.select("asked", "query", (-1 - block).cast("int").alias("cell")).mapInArrow(pack(False), schema).withColumn("block", -1 - F.col("cell"))
    both = every.union(split).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("cell")
    return both.drop("block").mapInArrow(search, f"`{names[0]}` {types[0]}, `{names[1]}` {types[1]}, score double")
