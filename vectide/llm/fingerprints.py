"""Operator 10, document fingerprints: MinHash signatures and the verified Jaccard similarity of documents that share a band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import positional, sized, written
from .near import BLOCK_DOCS, Found, Likeness, like_documents

#: Similarity 0.7 of the sets of word pairs; 16 bands of 5 find 0.95 of the pairs at the threshold itself, 0.998 at 0.8.
#: Signatures screen out only what has no chance of reaching the threshold.
PRINT = Likeness(threshold=0.7, bands=16, rows=5, seed=29, batch=40, miss=1e-6)


def _found(docs: DataFrame, text_col: str, id_col: str, how: Likeness, block_docs: int, links: bool) -> Found:
    columns, at = positional(docs)
    renamed = columns.select(F.col(at(id_col)).alias("__id"), F.col(at(text_col)).alias("__t"))
    return like_documents(renamed, "__t", how, keep=["__id"], links=links, block_docs=block_docs)


def _classes(found: Found) -> DataFrame:
    """(a, x, class_id, copies): the rows x whose words are those of a, the least of their ids, how many there are."""
    member = found.same.union(found.same.select("a", "a").distinct()).toDF("a", "x")
    named = written(found.rows.select("nid", "__id").join(sized(written(member), 16), F.col("nid") == F.col("x")))
    least = named.groupBy("a").agg(F.min(F.struct(F.col("__id").isNull().alias("n"), "__id")).alias("least"), F.count("*").alias("copies"))
    return named.join(sized(written(least), 48), "a").select("a", "x", F.col("least.__id").alias("class_id"), "copies")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: Likeness = PRINT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, class_id, copies, links, most_like.

    fingerprint holds the text's min-wise hashes (how.hashes little-endian
    uint32) of its word pairs.  Rows of the same words are one class, named by
    its least id (nulls last), of `copies` rows.  links is the number of other
    classes whose similarity reaches how.threshold, verified text against text,
    and most_like the greatest of these similarities, null without any.  So
    every link between different texts is counted, and a class of any number
    of rows adds no pairs.  The pairs themselves are similar_pairs().

    Null, empty and blank texts have an empty fingerprint, no links and no
    copies, each being a class of its own.  In scripts without white space every
    character counts as a word.  Texts of any length are read whole.  Repeated
    rows each have a row.  Ids may be of any type that has an order; null ids
    stay null.  An empty table gives an empty table; other columns are left out.
    """
    found = _found(docs, text_col, id_col, how, block_docs, links=True)
    counts = written(found.found.groupBy("nid").agg(F.sum("links").alias("links"), F.max("most").alias("most_like")))
    classes = written(_classes(found))
    tail = [F.col("links"), F.col("most_like")]
    several = classes.join(sized(counts, 24).withColumnRenamed("nid", "a"), "a", "left").select("x", "class_id", "copies", *tail)
    single = counts.join(sized(classes.select(F.col("a").alias("nid")).distinct(), 8), "nid", "left_anti")
    known = several.union(single.select(F.col("nid").alias("x"), F.lit(None).cast(classes.schema["class_id"].dataType), F.lit(1).cast("bigint"), *tail))
    rows = found.rows.select("nid", "__id", "sig").join(sized(written(known), 48), F.col("nid") == F.col("x"), "left")
    own = F.when(F.coalesce("copies", F.lit(1)) > 1, F.col("class_id")).otherwise(F.col("__id"))
    return rows.select(F.col("__id").alias(id_col), F.col("sig").alias("fingerprint"), own.alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), "most_like")


def similar_pairs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: Likeness = PRINT, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """((a_id, b_id, jaccard) of the pairs that fingerprints() counts, between one row of each class; (id, class_id) of rows that have copies).

    As many pairs as there are links between different texts; null ids are pairs' ids too.
    """
    found = _found(docs, text_col, id_col, how, block_docs, links=False)
    classes = written(_classes(found))
    ids = found.rows.select("nid", "__id").join(sized(classes.select(F.col("a"), F.col("class_id")).distinct(), 24), F.col("nid") == F.col("a"), "left")
    ids = ids.select("nid", F.when(F.col("a").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias("name"))
    pairs = found.found.join(ids.toDF("a", "a_id"), "a").join(ids.toDF("b", "b_id"), "b").select("a_id", "b_id", "jaccard")
    member = found.rows.select("nid", "__id").join(sized(classes, 32), F.col("nid") == F.col("x")).select(F.col("__id").alias(id_col), "class_id")
    return pairs, member
