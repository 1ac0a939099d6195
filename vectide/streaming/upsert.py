"""Continuous upserts: every micro-batch of a stream is one write of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Collection


def stream_upserts(rows: DataFrame, collection: Collection, checkpoint: str, order: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that upserts a streaming DataFrame (id, vector, metadata?, document?) into a collection.

    A batch that is run again after a failure writes the same rows again, and
    the last write of an id wins, so that the collection comes out the same.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            collection.upsert_df(batch, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(rows: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) per tumbling window of a stream; rows later than `late` behind are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
