"""Change logs of JSON lines: what is to be done again after the last checkpoint, up to the first damaged line."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import encode
from .files import Files

CHECKPOINT = "Checkpoint"


def replay(spark: SparkSession, path: str) -> DataFrame:
    """(pos, kind, body) of the entries to replay, kind being the name and body (VARIANT) the content of each.

    Lines count from 0.  Reading stops before the first line that isn't JSON;
    of what is left, only lines after the last checkpoint count.  Blank lines
    are nothing.  A file is one log, so its lines are numbered in one task.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where(F.length(F.trim("line")) > 0)
    parsed = text.withColumn("entry", F.try_parse_json("line"))
    marks = parsed.agg(
        F.min(F.when(F.col("entry").isNull(), F.col("pos"))).alias("bad"),
    )
    good = parsed.crossJoin(F.broadcast(marks)).where(F.col("bad").isNull() | (F.col("pos") < F.col("bad"))).drop("bad")
    is_mark = F.coalesce(F.try_variant_get("entry", "$", "string") == CHECKPOINT, F.lit(False)) & (F.schema_of_variant("entry") == "STRING")
    last = good.agg(F.max(F.when(is_mark, F.col("pos"))).alias("mark"))
    left = good.crossJoin(F.broadcast(last)).where(F.col("mark").isNull() | (F.col("pos") > F.col("mark")))
    fields = F.col("entry").try_cast("map<string,variant>")
    kind = F.when(F.schema_of_variant("entry") == "STRING", F.try_variant_get("entry", "$", "string")).otherwise(F.element_at(F.map_keys(fields), 1))
    return left.select("pos", kind.alias("kind"), F.element_at(F.map_values(fields), 1).alias("body"))


class ChangeLog:
    """A log that is appended to on the driver; each line is an object with one key, or the word for a checkpoint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        if not self.files.exists(path):
            self.files.write(path, "")

    def append(self, kind: str, body: dict[str, Any]) -> None:
        self.files.write(self.path, self.files.read(self.path) + encode({kind: body}) + "\n")

    def checkpoint(self) -> None:
        """Everything so far is durable elsewhere: the log starts anew."""
        self.files.write(self.path, "")

    def entry_count(self) -> int:
        return sum(1 for line in self.files.read(self.path).splitlines() if line.strip())

    def replay(self) -> list[dict[str, Any]]:
        rows = replay(self.spark, self.path).orderBy("pos").select("kind", F.to_json("body").alias("body")).collect()
        return [{r.kind: json.loads(r.body) if r.body is not None else None} for r in rows]
