"""What the operators share: slices of Arrow batches, row identity, tables in the shared folder, sized joins."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import shared_dir

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 1_000_000
#: A side of a join is broadcast up to this many bytes, counted, at most; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Scans of fewer parts are dealt out to all cores before Python works on them.
SMALL_PARTS = 8


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about `most` bytes; null reads as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, [t if t is not None else "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie in the shared folder."""
    return f"{shared_dir(spark)}/vectide-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; for when the results that read them have been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    void = [f.name for f in df.schema if f.dataType.typeName() == "void"]  # Parquet has no such type
    df.withColumns({c: F.col(c).cast("string") for c in void}).write.option("compression", compression).parquet(path)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in void else f.dataType, f.nullable) for f in df.schema])
    table = spark.read.schema(schema).parquet(path)
    return table.withColumns({c: F.lit(None) for c in void}) if void else table


def _is_scan(df: DataFrame) -> bool:
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


def with_row_id(df: DataFrame, file_col: str = "__file", row_col: str = "__row") -> DataFrame:
    """Adds two longs that tell rows apart and stay the same however often the table is read.

    They are a hash of the file's path and the row's place in it.  What isn't a
    plain scan of Parquet is first written to the shared folder.
    """
    names = df.columns
    if _is_scan(df) and "_metadata" not in names:
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias(file_col), F.col("_metadata.row_index").alias(row_col))
        except Exception as e:  # not Parquet: there is no row_index
            if "row_index" not in str(e) and "_metadata" not in str(e):
                raise
    return with_row_id(written(df), file_col, row_col)


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row: breaks ties alike however the table is laid out."""

    def plain(f: T.StructField) -> Column:
        nested = any(k in f.dataType.simpleString() for k in ("map<", "variant"))
        return F.to_json(F.struct(F.col(f"`{f.name}`"))) if nested else F.col(f"`{f.name}`")

    return F.xxhash64(*[plain(f) for f in df.schema if f.dataType.typeName() != "void"], F.lit(1))


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if its counted rows are small enough, else left to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def positional(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """(df with its columns called c0, c1, ..., what a name is called there).

    Names that differ in case only, or not at all, are told apart by place: the
    first that is written alike counts, else the first whatever its case.
    """
    names = df.columns

    def at(name: str) -> str:
        found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name!r} among {names}")
        return f"c{found[0]}"

    return df.toDF(*[f"c{i}" for i in range(len(names))]), at


def narrowed(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, list[T.StructField]]:
    """(the columns of keep as k0, k1, ... and the text, as a string, as t; the fields of keep under their own names)."""
    renamed, at = positional(df)
    out = renamed.select(*[F.col(at(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(at(text_col)).cast("string").alias("t"))
    return out, [T.StructField(c, f.dataType, True) for c, f in zip(keep, out.schema)]


_held: dict[str, Callable[[], object]] = {}


def claim(owner: str, release: Callable[[], object]) -> None:
    """Called in a Python worker by the operator that uses it: what other operators cached there is let go, and goes back to the system."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    _held[owner] = release
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is a scan of fewer than SMALL_PARTS parts (some 1 GB at most); else as it is."""
    if not _is_scan(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL_PARTS) else df


def map_text(df: DataFrame, text_col: str, schema: str | T.StructType, function: Callable[[pa.RecordBatch, int, list[str]], pa.RecordBatch]) -> DataFrame:
    """mapInArrow that hands `function` the batch's rows from `lo` on, with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(text_col)):
                yield function(batch.slice(lo, len(texts)), lo, texts)

    return spread(df).mapInArrow(run, schema)
