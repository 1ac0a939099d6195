"""Database and Collection: the interface that callers use, each query one Spark plan."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InternalError
from ..functions import values
from ..operators import ann, bm25, filters, fusion, search
from ..operators.merge import last_wins
from ..schema import DEFAULT_INDEX, DEFAULT_METRIC, ROWS, CollectionConfig, check_top_k, check_vector
from ..sources.files import shared_dir
from ..sources.store import CollectionStore, DatabaseStore



class Collection:
    """Rows of (id, vector, metadata, document) under one name."""

    def __init__(self, store: CollectionStore):
        self._store, self.config = store, store.config
        self.spark = store.spark
        self._ann: tuple[int, ann.AnnIndex | None] | None = None

    @property
    def name(self) -> str:
        return self.config.name

    @property
    def dimension(self) -> int:
        return self.config.dimension

    def __repr__(self):
        return "Collection(name=%r)" % self.name

    def rows(self) -> DataFrame:
        """The live rows as a DataFrame."""
        return self._store.rows()

    # -- writes

    def upsert(self, ids: Sequence[str], vectors: Sequence[Sequence[float]], metadata: Sequence[Mapping[str, Any] | None] | None = None, documents: Sequence[str | None] | None = None) -> None:
        """Adds or replaces rows as a whole; nothing is written unless all of them are sound; of one id the last wins."""
        n = len(ids)
        for what, given in (("vectors", vectors), ("metadata", metadata), ("documents", documents)):
            if given is not None and len(given) != n:
                raise InternalError(f"ids and {what} must have the same length")
        if not n:
            return
        checked = [check_vector(v, self.dimension) for v in vectors]
        metas = [values.encode(dict(m) if m is not None else {}) for m in (metadata or [None] * n)]
        data = [(str(i), v, m, d, k) for k, (i, v, m, d) in enumerate(zip(ids, checked, metas, documents or [None] * n))]
        rows = self.spark.createDataFrame(data, "id string, vector array<float>, metadata string, document string, seq bigint")
        self._store.add(rows.withColumn("metadata", F.parse_json("metadata")))

    def upsert_df(self, rows: DataFrame, order: str | None = None) -> None:
        """Adds or replaces the rows of a DataFrame (id, vector, and optionally metadata and document).

        Of rows with one id that of the greatest `order` wins (nulls lose); of equal ones, or without order, one
        that is chosen once, as it is written.  metadata may be a
        VARIANT, JSON text, or a struct.  A null id, a vector of another length or with
        components that are not finite fails the write; nothing is committed then.
        """
        types = dict(rows.dtypes)
        v = F.col("vector").cast("array<float>")
        sound = F.col("id").isNotNull() & (F.size(v) == self.dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        checked = F.when(F.coalesce(sound, F.lit(False)), v).otherwise(F.raise_error(F.lit(f"row is not sound: needs an id and {self.dimension} finite components")).cast("array<float>"))
        meta = F.parse_json(F.lit("{}"))
        if "metadata" in types:
            kind = types["metadata"]
            own = F.col("metadata") if kind == "variant" else F.parse_json("metadata") if kind == "string" else F.parse_json(F.to_json("metadata"))
            meta = F.coalesce(own, meta)
        doc = F.col("document").cast("string") if "document" in types else F.lit(None).cast("string")
        by = [F.col(order).alias("__order")] if order else []
        found = rows.select(F.col("id").cast("string").alias("id"), checked.alias("vector"), meta.alias("metadata"), doc.alias("document"), F.monotonically_increasing_id().alias("seq"), *by)
        if order:  # one row per id is written; the vector's size is the same for all, but makes sure that each is checked
            found = last_wins(found.withColumn("__size", F.size("vector")), "id", ("__order", "__size", "seq")).drop("__order", "__size")
        self._store.add(found)

    def delete(self, ids: Sequence[str]) -> list[bool]:
        """Deletes rows; for each id, in order, whether it was there (a repeated id only the first time)."""
        wanted = [str(i) for i in ids]
        if not wanted:
            return []
        keys = self.spark.createDataFrame([(i,) for i in dict.fromkeys(wanted)], "id string")
        there = {r[0] for r in self.rows().join(F.broadcast(keys), "id", "left_semi").select("id").collect()}
        if there:
            gone = self.spark.createDataFrame([(i, k) for k, i in enumerate(sorted(there))], "id string, seq bigint")
            empty = {f.name: F.lit(None).cast(f.dataType) for f in ROWS if f.name not in ("id", "seq")}
            self._store.add(gone.withColumns(empty), deleted=True)
        out = []
        for i in wanted:
            out.append(i in there)
            there.discard(i)
        return out

    def compact(self) -> None:
        self._store.compact()
        self._store.vacuum()

    # -- reads

    def count(self) -> int:
        return self.rows().count()

    def contains(self, id: str) -> bool:
        return bool(self.rows().where(F.col("id") == str(id)).select("id").take(1))

    def query_df(self, vector: Sequence[float], top_k: int = 10, filter: Mapping[str, Any] | None = None, prefilter: bool = False) -> DataFrame:
        """(id, score, metadata) of the nearest rows; score is a distance, lower is nearer."""
        q, k = check_vector(vector, self.dimension), check_top_k(top_k)
        keep = filters.compile(filter, filters.VariantFields(F.col("metadata"))) if filter is not None else None
        index = self._index()
        if index is not None and keep is None:
            found = index.search(q, k)
        elif index is not None and not prefilter:
            fetched = index.search(q, search.fetch_k(k)).where(keep)
            found = fetched.orderBy("score", "id").limit(k)
        else:
            rows = self.rows().select("id", "vector", "metadata")
            found = search.nearest(rows, q, k, self.config.metric) if keep is None else search.nearest_filtered(rows, q, k, keep, self.config.metric, prefilter=prefilter)
        return found.select("id", F.col("score").cast("float").alias("score"), "metadata")

    def query(self, vector: Sequence[float], top_k: int = 10, filter: Mapping[str, Any] | None = None, prefilter: bool = False) -> list[dict]:
        return _dicts(self.query_df(vector, top_k, filter, prefilter))

    def keyword_search_df(self, query: str, top_k: int = 10, variant: str = "reference", filter: Mapping[str, Any] | None = None) -> DataFrame:
        """(id, score, metadata) by BM25 over the rows that have a document; higher is better."""
        rows = self._filtered(filter).select("id", "metadata", "document")
        return bm25.search(rows, query, check_top_k(top_k), variant).select("id", F.col("score").cast("float").alias("score"), "metadata")

    def keyword_search(self, query: str, top_k: int = 10, variant: str = "reference", filter: Mapping[str, Any] | None = None) -> list[dict]:
        return _dicts(self.keyword_search_df(query, top_k, variant, filter))

    def hybrid_query_df(self, vector: Sequence[float], query: str, top_k=10, alpha=0.5, variant: str = "reference", filter: Mapping[str, Any] | None = None) -> DataFrame:
        """(id, score, metadata) by fusing vector and keyword ranks, alpha being the vectors' weight; higher is better."""
        q, k = check_vector(vector, self.dimension), check_top_k(top_k)
        many = search.fetch_k(k)
        rows = self._filtered(filter)
        near = fusion.ranked(search.nearest(rows.select("id", "vector"), q, many, self.config.metric), "score", "id")
        words = fusion.ranked(bm25.search(rows.select("id", "document"), query, many, variant), F.desc("score"), "id")
        fused = fusion.rrf(near, words, alpha, k)
        joined = rows.select("id", "metadata").join(F.broadcast(fused), "id")  # at most k rows are sent
        return joined.select("id", F.col("score").cast("float").alias("score"), "metadata", F.col("score").alias("__s")).orderBy(F.desc("__s"), "id").drop("__s")

    def hybrid_query(self, vector: Sequence[float], query: str, top_k=10, alpha=0.5, variant: str = "reference", filter: Mapping[str, Any] | None = None) -> list[dict]:
        return _dicts(self.hybrid_query_df(vector, query, top_k, alpha, variant, filter))

    def batch_query_df(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, id, score, rank) for a DataFrame of (query_id, query)."""
        return search.batch_nearest(self.rows(), queries, top_k, self.config.metric)

    def _filtered(self, filter: Mapping[str, Any] | None) -> DataFrame:
        rows = self.rows()
        return rows if filter is None else filters.where(rows, filter)

    def _index(self) -> ann.AnnIndex | None:
        """The approximate index of the present version, built when first asked for; none for small collections."""
        if self.config.index == "flat":
            return None
        version = self._store.manifest().version
        if self._ann is None or self._ann[0] != version:
            path = f"{self._store.path}/ann/{version:012d}-{uuid.uuid4().hex}"
            index = None
            if self.count() >= ann.EXACT_BELOW:
                ann.AnnIndex.write(self.rows().select("id", "vector", "metadata"), path, self.config.metric)
                index = ann.AnnIndex.open(self.spark, path)
            self._ann = (version, index)
        return self._ann[1]


class Database:
    """Named collections: under a path, which is opened if it is there, or else in the session's shared folder."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.path = path
        self._store = DatabaseStore(self.spark, path or f"{shared_dir(self.spark)}/database-{uuid.uuid4().hex}")
        self._open: dict[str, Collection] = {}
        self._lock = threading.RLock()

    def create_collection(self, name, dimension, metric=DEFAULT_METRIC, index=DEFAULT_INDEX) -> Collection:
        with self._lock:
            self._open[name] = Collection(self._store.create(CollectionConfig(name, dimension, metric, index)))
            return self._open[name]

    def get_collection(self, name: str) -> Collection:
        with self._lock:
            if name not in self._open:
                self._open[name] = Collection(self._store.open(name))
            return self._open[name]

    def list_collections(self) -> list[str]:
        return self._store.names()

    def delete_collection(self, name: str) -> None:
        with self._lock:
            self._store.drop(name)
            self._open.pop(name, None)

    def __repr__(self) -> str:
        return f"Database(collections={len(self.list_collections())})"


def _dicts(df: DataFrame) -> list[dict]:
    """Result rows as dicts; they are few, top_k at most."""
    return [{"id": r["id"], "score": r["score"], "metadata": r["metadata"].toPython() if r["metadata"] is not None else {}} for r in df.collect()]
