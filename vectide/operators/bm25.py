"""Keyword search by BM25, over the texts themselves or over an inverted index kept as a table."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import query_tokens, tokens
from ..schema import check_top_k

K1, B = 1.2, 0.75
VARIANTS = ("reference", "okapi")
#: Words that one task of an index's writing sorts, as far as WRITERS tasks are enough for that; up to
#: 200 a shuffle's map side holds no rows in memory, and beyond them sorts spill.
TASK_WORDS, WRITERS = 2_000_000, 200


def term_score(tf: Column, spread: Column, length: Column, n: Column, average: Column, variant: str) -> Column:
    """What one query term adds to a document's score.

    reference: `spread` is how often the term occurs in all documents (idf may
    be negative), and each occurrence in the document adds the whole term.
    okapi: `spread` is how many documents have it, and it is added once.
    """
    if variant not in VARIANTS:
        raise EngineError(f"unknown BM25 variant: {variant}")
    idf = F.log((n - spread + 0.5) / (spread + 0.5) + 1.0) if variant == "okapi" else F.log((n + 1.0) / (spread + 0.5))
    norm = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / average))
    return (tf if variant == "reference" else F.lit(1.0)) * idf * norm


def _count(word: str, column: str) -> Column:
    return F.size(F.filter(column, lambda t: t == F.lit(word))).cast("double")


def corpus_stats(docs: DataFrame, text: str = "document") -> DataFrame:
    """One row: n_docs and avg_len over the rows that have a text; 0 and 0 without any."""
    size = F.size(tokens(F.col(text)))
    return docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"))


def search(docs: DataFrame, query: str, top_k: int | None, variant: str = "reference", text: str = "document", tie: str = "id") -> DataFrame:
    """The rows of docs with any word of query, with `score`, best first; ties by `tie`; all of them if top_k is None.

    Two narrow passes, no shuffle of rows: one sums up the corpus and the query's
    words, the other scores.  A word that the query repeats counts as often.
    """
    words = Counter(query_tokens(query))
    scored = docs.where(F.col(text).isNotNull())
    if not words:
        return docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
    terms = list(words)
    # The generator keeps the optimizer from repeating the tokens' expression for every word.
    found = scored.select("*", F.explode(F.array(tokens(F.col(text)))).alias("__tokens"))
    counts = [_count(w, "__tokens").alias(f"__tf{i}") for i, w in enumerate(terms)]
    found = found.select("*", F.size("__tokens").cast("double").alias("__len"), *counts).drop("__tokens")
    spread = [(F.sum(f"__tf{i}") if variant == "reference" else F.sum(F.when(F.col(f"__tf{i}") > 0, 1.0).otherwise(0.0))).alias(f"__all{i}") for i in range(len(terms))]
    totals = found.agg(F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__avg"), *spread)  # one row
    joined = found.where(reduce(lambda a, b: a | b, (F.col(f"__tf{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(totals))
    parts = [F.when(F.col(f"__tf{i}") > 0, F.lit(float(words[w])) * term_score(F.col(f"__tf{i}"), F.col(f"__all{i}"), F.col("__len"), F.col("__n"), F.col("__avg"), variant)).otherwise(0.0) for i, w in enumerate(terms)]
    out = joined.select(*docs.columns, reduce(lambda a, b: a + b, parts).alias("score"))
    return out if top_k is None else out.orderBy(F.desc("score"), tie).limit(check_top_k(top_k))


@dataclass(frozen=True)
class TextIndex:
    """An inverted index as a table (term, id, tf, length), parted by a hash of the term; each file is sorted by it.

    A search reads the parts of its words only, and of these the row groups that
    have them.  Statistics of the corpus are one row beside it.
    """

    postings: DataFrame
    stats: DataFrame
    parts: int

    @staticmethod
    def write(docs: DataFrame, path: str, parts: int = 64, text: str = "document", key: str = "id") -> None:
        """A text's words are counted within its row.  Each part is written by as many tasks as its words need, each sorting its own file."""
        corpus_stats(docs, text).withColumn("parts", F.lit(parts)).write.parquet(f"{path}/stats")
        known = docs.sparkSession.read.parquet(f"{path}/stats").first()
        slices = max(1, min(-(-int(known.n_docs * known.avg_len) // (parts * TASK_WORDS)), WRITERS // parts))
        some = docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("ts"))
        # The generators keep the optimizer from repeating the expressions for every word.
        ordered = some.select(F.col(key), F.explode(F.array(F.sort_array("ts"))).alias("ts")).where(F.size("ts") > 0)
        n = F.size("ts")
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
        runs = ordered.select(key, "ts", F.explode(F.array(first)).alias("first")).select(key, "ts", "first", F.posexplode("first").alias("at", "start"))
        tf = F.coalesce(F.get("first", F.col("at") + 1), n) - F.col("start")
        postings = runs.select(F.get("ts", "start").alias("term"), key, n.alias("length"), tf.cast("bigint").alias("tf")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        task = F.col("part") * slices + F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
        postings.repartitionById(parts * slices, task).sortWithinPartitions("part", "term", key).write.partitionBy("part").parquet(f"{path}/postings")

    @staticmethod
    def open(spark, path: str) -> TextIndex:
        stats = spark.read.parquet(f"{path}/stats")
        row = stats.select("parts").first()
        return TextIndex(spark.read.parquet(f"{path}/postings"), stats, row[0] if row else 1)

    def search(self, query: str, top_k: int, variant: str = "reference", key: str = "id") -> DataFrame:
        """(key, score) as search() gives."""
        words = Counter(query_tokens(query))
        if not words:
            return self.postings.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
        spark = self.postings.sparkSession
        wanted = spark.createDataFrame(list(words.items()), "term string, qtf bigint")
        parts = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int")).distinct().collect()]
        hits = self.postings.where(F.col("part").isin(parts) & F.col("term").isin(list(words))).groupBy("term", key, "length").agg(F.sum("tf").alias("tf"))
        spread = F.sum("tf") if variant == "reference" else F.count("*")
        common = hits.groupBy("term").agg(spread.cast("double").alias("spread"))
        joined = hits.join(F.broadcast(wanted), "term").join(F.broadcast(common), "term").crossJoin(F.broadcast(self.stats))
        score = F.col("qtf") * term_score(F.col("tf").cast("double"), F.col("spread"), F.col("length").cast("double"), F.col("n_docs").cast("double"), F.col("avg_len"), variant)
        return joined.groupBy(key).agg(F.sum(score).alias("score")).orderBy(F.desc("score"), key).limit(check_top_k(top_k))
