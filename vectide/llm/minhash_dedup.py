"""Operator 7, MinHash near-dedup: banded candidates, sequential Bayesian pruning, exact verification, one row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import content_hash, positional, sized, written
from .components import components
from .near import BLOCK_DOCS, Likeness, like_documents

#: Similarity 0.6 of the sets of word pairs; 30 bands of 5 find 0.91 of the pairs at the threshold itself, 0.99 at 0.7.
NEAR = Likeness(threshold=0.6, bands=30, rows=5, batch=30, miss=0.01, forest=True)


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: Likeness = NEAR, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with one row of each group of near duplicates, the one of least id; of equal ids, that whose columns hash lowest.

    Two rows are near duplicates if the Jaccard similarity of their word pairs
    reaches how.threshold; groups are the connected components.  A candidate is
    dropped once the posterior probability that it reaches the threshold is
    under how.miss; the others are verified exactly; pairs of documents that are
    already joined need no check.

    Null, empty and blank texts have no words: they are like nothing and stay.
    A text of one word is like that word alone.  Words are set apart by white
    space; in scripts that have none, every character is one.  Texts of any
    length are read whole.  Ids may be of any type that has an order; null ids
    come last.  Repeated rows are one group.  An empty table gives an empty
    table; other columns pass through, whatever their names.
    """
    names = docs.columns
    renamed, at = positional(docs)
    marked = renamed.withColumns({"__id": F.col(at(id_col)), "__tie": content_hash(renamed)})
    found = like_documents(marked, at(text_col), how, keep=["__id", "__tie"], block_docs=block_docs)
    groups = written(components(found.found.select("a", "b").union(found.same)))
    ranked = written(found.rows.select("nid", "__id", "__tie", "__file", "__row").join(sized(groups, 16), F.col("nid") == F.col("node")))
    order = F.struct(F.col("__id").isNull().alias("n"), "__id", "__tie", "__file", "__row")
    least = ranked.groupBy("root").agg(F.min(order).alias("least"))
    gone = ranked.join(sized(written(least), 64), "root").where(order != F.col("least")).select(F.col("__file").alias("__f"), F.col("__row").alias("__r"))
    gone = sized(written(gone), 16)
    kept = found.table.join(gone, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r")), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
