"""Operator 3, exact dedup: snapshots screened by binary fuse filters, bytes compared for what passes, batches grouped apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import content_hash, positional, sized, with_row_id, written
from .fuse import FuseFilter, build

#: Digests in one shard of a snapshot's filter.
SHARD_KEYS = 500_000
_FILTER = "shard bigint, seed string, segment bigint, span bigint, prints binary"


def digests(text: Column) -> list[Column]:
    """Two independent 64-bit digests of a text."""
    return [F.xxhash64(text).alias("__d1"), F.xxhash64(F.lit(0x5EED), text).alias("__d2")]


def snapshot_filters(keys: DataFrame, shards: int) -> DataFrame:
    """One binary fuse filter per shard of the distinct digests of an immutable snapshot (columns __d1, __d2)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build(pdf["__d1"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "seed": [str(f.seed)], "segment": [f.segment], "span": [f.span], "prints": [f.prints]})

    return keys.withColumn("shard", F.pmod("__d2", F.lit(shards))).groupBy("shard").applyInPandas(one, _FILTER)


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Those incoming digests that a snapshot's filters let pass; filters travel by shard and are not broadcast."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[["__d1", "__d2"]].iloc[:0]
        r = right.iloc[0]
        f = FuseFilter(int(r["seed"]), int(r["segment"]), int(r["span"]), bytes(r["prints"]))
        return left.loc[f.contains(left["__d1"].to_numpy(np.int64).view(np.uint64)), ["__d1", "__d2"]]

    sharded = incoming.withColumn("shard", F.pmod("__d2", F.lit(shards)))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(one, "__d1 bigint, __d2 bigint")


def duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame]:
    """(docs with row ids, row ids of the rows whose very text an earlier row has).

    The table is taken in as two batches, parted by a hash of ids.  What is
    distinct in the first becomes a snapshot with its filters; the second is
    screened by them, and what passes is joined to the snapshot's digests.  Each
    batch's own repeats are found by grouping its digests.  Only the rows of
    digests found twice have their texts read again, to be grouped by the texts
    themselves: copies are merged before they are shuffled, so that no group,
    however large, meets in one task.
    """
    table = with_row_id(docs)
    text = F.col(f"`{text_col}`").cast("string")
    rows = written(table.where(text.isNotNull()).select("__file", "__row", F.col(f"`{id_col}`").alias("__id"), content_hash(docs).alias("__tie"), *digests(text)))
    keys = written(rows.groupBy((F.pmod(F.xxhash64("__id"), F.lit(2)) == 0).alias("__first"), "__d1", "__d2").agg(F.count("*").alias("n")))
    snapshot, batch = keys.where("__first"), keys.where("not __first")
    most = max([r[1] for r in keys.groupBy("__first").count().collect()], default=0)
    shards = max(1, -(-most // shard_keys))
    filters = written(snapshot_filters(snapshot.select("__d1", "__d2"), shards))
    passed = screen(batch.select("__d1", "__d2"), filters, shards)
    known = passed.join(snapshot.select("__d1", "__d2"), ["__d1", "__d2"])
    again = written(known.union(keys.where("n > 1").select("__d1", "__d2")).distinct())
    suspects = written(rows.join(sized(again, 16), ["__d1", "__d2"]))
    at = sized(suspects.withColumnsRenamed({"__file": "__f", "__row": "__r"}), 64)
    texts = table.select("__file", "__row", text.alias("__text")).join(at, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r")))
    # Digests that stand for more than one text: none, but for a collision of 128 bits.
    clash = written(texts.groupBy("__d1", "__d2", "__text").agg(F.lit(1)).groupBy("__d1", "__d2").agg(F.count("*").alias("n")).where("n > 1").select("__d1", "__d2"))
    clashes = clash.count()
    later = _later(suspects.join(F.broadcast(clash), ["__d1", "__d2"], "left_anti") if clashes else suspects, ["__d1", "__d2"])
    if clashes:
        later = later.union(_later(texts.join(sized(clash, 16), ["__d1", "__d2"], "left_semi"), ["__d1", "__d2", "__text"]))
    return table, written(later)


def _later(rows: DataFrame, by: list[str]) -> DataFrame:
    """Places of all but the first row of each group: of least id, nulls last, then of least content hash."""
    order = F.struct(F.col("__id").isNull().alias("n"), "__id", "__tie", "__file", "__row")
    least = written(rows.groupBy(*by).agg(F.min(order).alias("__least")))
    joined = rows.join(sized(least, 96) if "__text" not in by else least, by)
    return joined.where(order != F.col("__least")).select(F.col("__file").alias("__f"), F.col("__row").alias("__r"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs without the rows whose text, byte for byte, a row of a lower id has.

    Ids may be of any type that has an order, and are ordered as that type is;
    null ids come after all others.  Of equal ids that row stays whose columns
    hash lowest, so that the same rows stay however the table is laid out.
    Null texts are unknown, so never duplicates: they stay.  Empty texts are
    equal to one another.  Texts of any length are compared whole.  Repeated
    rows are duplicates like any other.  An empty table gives an empty table;
    other columns pass through, whatever their names.
    """
    names = docs.columns
    renamed, at = positional(docs)
    table, later = duplicates(renamed, at(text_col), at(id_col), shard_keys)
    later = sized(later, 16)
    kept = table.join(later, (table["__file"] == later["__f"]) & (table["__row"] == later["__r"]), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
