"""Every operator as a query over the given tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions.distance import distance
from ..functions.text import tokens
from ..operators import ann, bm25, filters, fusion, merge, search
from ..schema import CollectionConfig
from ..sources import changelog
from ..sources.files import Files, shared_dir
from ..sources.store import CollectionStore
from ..streaming.upsert import stream_upserts
from .catalog import Collection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = "three über élan the"


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that is searched for; one row, read when the query is planned."""
    return list(_vectors(spark, sf_dir).where("vec_id = 0").select("vector").first()[0])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))


def _scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


# -- nearest rows

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_D = {
    "cosine": f"list_cosine_distance(embedding::DOUBLE[], {_Q})",
    "euclidean": f"list_distance(embedding::DOUBLE[], {_Q})",
    "dot": f"list_negative_inner_product(embedding::DOUBLE[], {_Q})",
}


def _topk_sql(metric: str, k: int | None = 10, where: str = "true") -> str:
    limit = f"LIMIT {k}" if k is not None else ""
    return f"SELECT vec_id, round(d, 6) AS score FROM (SELECT vec_id, {_D[metric]} AS d FROM embeddings WHERE {where}) ORDER BY d, vec_id {limit}"


def _add_topk(metric: str) -> None:
    @_query(_topk_sql(metric), f"vector_topk_{metric}")
    def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(search.nearest(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10, metric, tie="vec_id"), "vec_id")


for _metric in ("cosine", "euclidean", "dot"):
    _add_topk(_metric)


@_query("SELECT vec_id, 1.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def vector_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero vector is at distance 1 from everything, so that ids decide."""
    return _scored(search.nearest(_vectors(spark, sf_dir), [0.0] * 64, 10, "cosine", tie="vec_id"), "vec_id")


@_query(_topk_sql("cosine", None))
def vector_topk_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _scored(search.nearest(rows, _first_vector(spark, sf_dir), rows.count() + 1000, "cosine", tie="vec_id"), "vec_id")


@_query("SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(list_negative_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three metrics between pairs of rows."""
    a = _vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    columns = [F.round(distance(F.col("vector"), F.col("other"), m, 64), 6).alias(m) for m in ("cosine", "euclidean", "dot")]
    return a.join(b, "vec_id").select("vec_id", *columns)


@_query("SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def sql_function_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    sql_functions.register(spark)
    return spark.sql(
        "SELECT a.vec_id, round(cosine_distance(a.vector, b.vector), 6) AS score FROM {rows} a CROSS JOIN (SELECT vector FROM {rows} WHERE vec_id = 0) b",
        rows=_vectors(spark, sf_dir),
    )


@_query("SELECT query_id, vec_id, rank::INTEGER AS rank, round(d, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank FROM embeddings e, embeddings q) WHERE rank <= 10")
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector."""
    rows = _vectors(spark, sf_dir)
    found = search.batch_nearest(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), 10, "cosine", row_id="vec_id")
    return _scored(found, "query_id", "vec_id", "rank")


@_query()
def knn_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector, the share of its ten nearest that the approximate index finds."""
    rows = _vectors(spark, sf_dir)
    path = f"{shared_dir(spark)}/ann-{uuid.uuid4().hex}"
    ann.AnnIndex.write(rows, path, "cosine")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    found = ann.AnnIndex.open(spark, path).batch_search(queries, 10, row_id="vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = search.batch_nearest(rows, queries, 10, "cosine", row_id="vec_id").select("query_id", "vec_id")
    return exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


# -- filters

_DOCS = "documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


def _add_filter(name: str, spec: dict[str, Any], where: str) -> None:
    @_query(f"SELECT doc_id FROM {_DOCS} WHERE {where}", f"filter_{name}")
    def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _labelled(spark, sf_dir)
        return rows.where(filters.compile(spec, filters.TypedFields(rows))).select("doc_id")

    @_query(f"SELECT doc_id FROM {_DOCS} WHERE {where}", f"filter_{name}_variant")
    def filtered_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _labelled(spark, sf_dir)
        data = rows.select("doc_id", F.parse_json(F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic"))).alias("metadata"))
        return filters.where(data, spec).select("doc_id")


for _name, _spec, _where in (
    ("eq", {"lang": {"$eq": "fr"}}, "lang = 'fr'"),
    ("eq_shorthand", {"lang": "de"}, "lang = 'de'"),
    ("ne_missing", {"toxic": {"$ne": 1}}, "toxic IS NULL OR toxic <> 1"),
    ("gt", {"n_chars": {"$gt": 2000}}, "n_chars > 2000"),
    ("gte", {"n_chars": {"$gte": 2000.5}}, "n_chars >= 2000.5"),
    ("lt", {"lang": {"$lt": "en"}}, "lang < 'en'"),
    ("lte", {"n_chars": {"$lte": 300}}, "n_chars <= 300"),
    ("in", {"source": {"$in": ["src1", "src7", 3]}}, "source IN ('src1', 'src7')"),
    ("nin_missing", {"quality": {"$nin": [1]}}, "quality IS NULL OR quality NOT IN (1)"),
    ("and", {"$and": [{"lang": "en"}, {"n_chars": {"$gte": 1000}}]}, "lang = 'en' AND n_chars >= 1000"),
    ("or", {"$or": [{"lang": "fr"}, {"toxic": 1}]}, "lang = 'fr' OR coalesce(toxic = 1, false)"),
    ("nested", {"$or": [{"$and": [{"lang": "es"}, {"n_chars": {"$gt": 500, "$lt": 5000}}]}, {"quality": 0}]}, "(lang = 'es' AND n_chars > 500 AND n_chars < 5000) OR coalesce(quality = 0, false)"),
    ("empty", {}, "true"),
    ("strict_types", {"n_chars": {"$eq": "2000"}}, "false"),
):
    _add_filter(_name, _spec, _where)


@_query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def filter_json_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("metadata"))
    return filters.where(rows, {"k": {"$gte": 50}}).select("event_id")


@_query(f"SELECT vec_id, round(d, 6) AS score FROM (SELECT vec_id, label, {_D['cosine']} AS d FROM embeddings ORDER BY d, vec_id LIMIT 100) WHERE label = 3 ORDER BY d, vec_id LIMIT 10")
def filtered_topk_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter sees the hundred nearest only."""
    rows = _vectors(spark, sf_dir)
    keep = filters.compile({"label": 3}, filters.TypedFields(rows))
    return _scored(search.nearest_filtered(rows, _first_vector(spark, sf_dir), 10, keep, "cosine", tie="vec_id"), "vec_id")


@_query(_topk_sql("cosine", 10, "label = 3"))
def filtered_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the scan."""
    rows = _vectors(spark, sf_dir)
    keep = filters.compile({"label": 3}, filters.TypedFields(rows))
    return _scored(search.nearest_filtered(rows, _first_vector(spark, sf_dir), 10, keep, "cosine", tie="vec_id", prefilter=True), "vec_id")


# -- keywords

_TOK = r"tok AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if strlen(x) > 1] AS ts FROM documents WHERE text IS NOT NULL)"


def _bm25_ctes(words: list[tuple[str, int]], variant: str = "reference", source: str | None = None) -> str:
    tok = _TOK if source is None else source
    q = ", ".join(f"('{w}', {n})" for w, n in words)
    tf, spread, idf = "tf", "sum(tf)", "ln((n + 1) / (cf + 0.5))"
    if variant == "okapi":
        tf, spread, idf = "1", "count(*)", "ln((n - cf + 0.5) / (cf + 0.5) + 1)"
    return f"""{tok},
        q AS (SELECT * FROM (VALUES {q}) AS v(term, qtf)),
        st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS a FROM tok),
        occ AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
        tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        cf AS (SELECT term, {spread}::DOUBLE AS cf FROM tf GROUP BY term),
        kw AS (SELECT doc_id, sum(qtf * {tf} * {idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN cf USING (term) JOIN q USING (term), st GROUP BY doc_id)"""


def _words(text: str) -> list[tuple[str, int]]:
    out: dict[str, int] = {}
    for w in text.split():
        out[w] = out.get(w, 0) + 1
    return list(out.items())


@_query(f"WITH {_TOK} SELECT doc_id, len(ts)::INTEGER AS n_tokens, len(list_distinct(ts))::INTEGER AS n_distinct FROM tok")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _texts(spark, sf_dir).where("document IS NOT NULL").select("doc_id", tokens(F.col("document")).alias("ts"))
    return found.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"))


@_query(f"WITH {_TOK} SELECT count(*) AS n_docs, round(avg(len(ts)), 6) AS avg_len FROM tok")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(_texts(spark, sf_dir)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def _add_bm25(name: str, text: str, k: int | None, variant: str = "reference") -> None:
    limit = f"ORDER BY s DESC, doc_id LIMIT {k}" if k else ""

    @_query(f"WITH {_bm25_ctes(_words(text), variant)} SELECT doc_id, round(s, 6) AS score FROM kw {limit}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(bm25.search(_texts(spark, sf_dir), text, k, variant, tie="doc_id"), "doc_id")


_add_bm25("bm25_keyword", WORDS, 10)
_add_bm25("bm25_keyword_all", WORDS, None)
_add_bm25("bm25_negative_idf", "the of", None)
_add_bm25("bm25_repeated_query_term", "the the idiot", None)
_add_bm25("bm25_okapi", WORDS, 10, "okapi")


@_query(f"WITH {_bm25_ctes(_words(WORDS))} SELECT doc_id, round(s, 6) AS score FROM kw ORDER BY s DESC, doc_id LIMIT 10")
def bm25_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an inverted index, built here."""
    path = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
    bm25.TextIndex.write(_texts(spark, sf_dir), path, parts=8, key="doc_id")
    return _scored(bm25.TextIndex.open(spark, path).search(WORDS, 10, key="doc_id"), "doc_id")


# -- hybrid

_BOTH = "both_ AS (SELECT doc_id, embedding, text, lang FROM documents JOIN embeddings ON vec_id = doc_id)"
_BOTH_TOK = _TOK.replace("FROM documents", "FROM both_")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), "lang", "source")
    return docs.join(_vectors(spark, sf_dir), F.col("doc_id") == F.col("vec_id")).drop("vec_id")


def _hybrid(spark: SparkSession, sf_dir: str, alpha: float) -> DataFrame:
    rows = _both(spark, sf_dir)
    near = fusion.ranked(search.nearest(rows.select("doc_id", "vector"), _first_vector(spark, sf_dir), 100, "cosine", tie="doc_id"), "score", "doc_id", key="doc_id")
    words = fusion.ranked(bm25.search(rows.select("doc_id", "document"), WORDS, 100, tie="doc_id"), F.desc("score"), "doc_id", key="doc_id")
    return fusion.rrf(near, words, alpha, 10, key="doc_id")


def _hybrid_sql(alpha: float, columns: str = "", join: str = "") -> str:
    return f"""WITH {_BOTH}, {_bm25_ctes(_words(WORDS), source=_BOTH_TOK)},
        v AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS r FROM (SELECT doc_id, {_D['cosine']} AS d FROM both_) ORDER BY r LIMIT 100),
        k AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM kw ORDER BY r LIMIT 100),
        f AS (SELECT doc_id, coalesce({alpha}::DOUBLE / (60 + v.r), 0) + coalesce((1 - {alpha}::DOUBLE) / (60 + k.r), 0) AS s FROM v FULL JOIN k USING (doc_id)),
        t AS (SELECT * FROM f ORDER BY s DESC, doc_id LIMIT 10)
        SELECT doc_id, round(s, 6) AS score{columns} FROM t {join}"""


def _add_hybrid(alpha: float) -> None:
    @_query(_hybrid_sql(alpha), f"hybrid_alpha_{round(alpha * 100):03d}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(_hybrid(spark, sf_dir, alpha), "doc_id")


for _quarter in range(5):
    _add_hybrid(_quarter / 4)


@_query(_hybrid_sql(0.5, ", lang, source", "JOIN documents USING (doc_id)"))
def hybrid_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fused rows sent to where the metadata is."""
    fused = _hybrid(spark, sf_dir, 0.5)
    meta = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return _scored(meta.join(F.broadcast(fused), "doc_id"), "doc_id", "lang", "source")


@_query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents WHERE lang = 'en') SELECT doc_id, round(0.3 / (60 + a.r) + coalesce(0.7 / (60 + b.r), 0), 9) AS score FROM a LEFT JOIN b USING (doc_id)")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    a = fusion.ranked_all(docs, F.desc("n_chars"), "doc_id", key="doc_id")
    b = fusion.ranked_all(docs.where("lang = 'en'"), "n_chars", "doc_id", key="doc_id")
    return fusion.rrf(a, b, 0.3, key="doc_id").select("doc_id", F.round("score", 9).alias("score"))


# -- writes

@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_wins(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


@_query("SELECT vec_id, label + 100 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 3")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three labels written again, twice, over the table."""
    old = _vectors(spark, sf_dir).select("vec_id", "label", F.lit(0).alias("seq"))
    new = old.where("label < 3")
    twice = new.select("vec_id", (F.col("label") + 50).alias("label"), F.lit(1).alias("seq")).union(new.select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("seq")))
    return merge.upsert(old, twice, "vec_id").select("vec_id", "label")


@_query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return merge.delete(_vectors(spark, sf_dir).select("vec_id", "label"), keys, "vec_id")


def _collection(spark: SparkSession, index: str = "flat") -> Collection:
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    return Collection(CollectionStore.create(spark, path, CollectionConfig("t", 64, "cosine", index)))


@_query("SELECT count(*) AS n FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")
def count_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in a stored collection after some are deleted."""
    c = _collection(spark)
    c.upsert_df(_vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), "vector"))
    c.delete(["1", "2", "3", "no such id"])
    return c.rows().agg(F.count("*").alias("n"))


@_query("SELECT vec_id::VARCHAR AS id, label + (CASE WHEN label = 4 THEN 1000 ELSE 0 END) AS label FROM embeddings WHERE label <> 5")
def store_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection written, partly written again, partly deleted, compacted, and read."""
    c, rows = _collection(spark), _vectors(spark, sf_dir).withColumn("id", F.col("vec_id").cast("string"))
    c.upsert_df(rows.select("id", "vector", F.struct("label").alias("metadata")))
    c.upsert_df(rows.where("label = 4").select("id", "vector", F.struct((F.col("label") + 1000).alias("label")).alias("metadata")))
    gone = rows.where("label = 5").select("id", F.monotonically_increasing_id().alias("seq"))
    none = {"vector": "array<float>", "metadata": "variant", "document": "string"}
    c._store.add(gone.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}), deleted=True)
    c.compact()
    return c.rows().select("id", F.variant_get("metadata", "$.label", "int").alias("label"))


@_query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation WHERE n_nationkey BETWEEN 10 AND 19")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a checkpoint after key 9 and a damaged line after key 19."""
    lines = []
    for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # the lines of one log
        lines.append('{"Upsert":{"key":%d,"name":"%s"}}' % (r.n_nationkey, r.n_name))
        lines += ['"Checkpoint"'] * (r.n_nationkey == 9) + ['{"Upsert":{"key":'] * (r.n_nationkey == 19)
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    Files(spark).write(path, "\n".join(lines) + "\n")
    body = changelog.replay(spark, path)
    return body.select(F.variant_get("body", "$.key", "bigint").alias("key"), F.variant_get("body", "$.name", "string").alias("name"))


@_query("SELECT vec_id::VARCHAR AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read as a stream into a collection."""
    c = _collection(spark)
    schema = _table(spark, sf_dir, "embeddings").schema
    path = f"{sf_dir}/embeddings.parque[t]"  # a pattern may name a file; a plain path of a stream must be a folder
    rows = spark.readStream.schema(schema).parquet(path).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    stream_upserts(rows, c, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return c.rows().select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))
