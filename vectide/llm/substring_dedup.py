"""Operator 9, substring dedup: chunks cut where a gear hash of the content says so, known again by their digests."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import BROADCAST_BYTES, claim, map_text, positional, with_row_id, written
from .shingles import word_flags

#: Bytes of a chunk on average; the hash sees WINDOW bytes; text without a cut is cut at LONGEST.
AVERAGE, WINDOW, LONGEST = 24, 32, 1024
#: Digests that so many rows of a sample of one in HOT_SHARE hold are counted before they are shuffled, HOT_MOST of them at most.
HOT_SHARE, HOT_LEAST, HOT_MOST = 64, 16, 10_000
#: Words that a run of repeated chunks has at least to be reported. Chunks cover all but the ends of a repeated passage:
#: of one of 50 words some 36 on average; fewer than 20 in about 1 % of cases. Stock phrases of a line are shorter.
LEAST_WORDS = 20


@lru_cache(maxsize=2)
def gear(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, pad: np.ndarray | None = None) -> np.ndarray:
    """At each byte the sum of gear[b] << age over the last 32 bytes, mod 2**32; bytes under pad count 0."""
    h = gear()[data]
    if pad is not None:
        h[pad] = 0
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_texts(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text of each chunk, its first byte there, its half words, its bytes): chunks cover their texts; empty texts have none.

    Words that begin in a chunk count two, characters of scripts without spaces one each.

    Where a chunk ends depends on the 32 bytes before it alone (and on three
    after it, so that no character is cut), so that what is put in before
    leaves later chunks as they are.
    """
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    gap = b"\n" * WINDOW
    data = np.frombuffer(gap.join(coded) + gap, np.uint8)
    begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    end = begin + sizes
    pad = (end[:, None] + np.arange(WINDOW)).ravel()
    cut = gear_hashes(data, pad) < np.uint32((1 << 32) // AVERAGE)
    cut[pad] = False
    at = np.flatnonzero(cut) + 1
    for _ in range(3):
        at = at + ((data[at] & 0xC0) == 0x80)
    full = sizes > 0
    edges = np.unique(np.concatenate([at, begin[full], end[full]]))
    first = np.searchsorted(begin[full], edges, "right") - 1
    inside = edges < end[full][first] if full.any() else np.zeros(0, bool)
    starts, stops = edges[inside], edges[np.flatnonzero(inside) + 1] if full.any() else edges
    wide = -(-(stops - starts) // LONGEST)
    if len(wide) and wide.max() > 1:
        part = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        s, e = np.repeat(starts, wide) + part * LONGEST, np.repeat(stops, wide)
        for _ in range(3):
            s = s + ((part > 0) & ((data[s] & 0xC0) == 0x80))
        starts, stops = s, np.where(np.append(part[1:], 0) > 0, np.append(s[1:], 0), e)
    begins, _, alone = word_flags(data)
    words = np.cumsum(begins * np.where(alone, 1, 2))
    ahead = np.concatenate([[0], words])
    whole = data.tobytes()
    where = np.flatnonzero(full)[np.searchsorted(begin[full], starts, "right") - 1] if full.any() else np.zeros(0, np.int64)
    return where, starts - begin[where], ahead[stops] - ahead[starts], [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]


#: Set in pos for chunks of hot digests.
_HOT = 1 << 62


def _chunk_rows(docs: DataFrame, keep: list[str], hot: dict[int, int] | None = None, hot_only: bool = False) -> DataFrame:
    """(columns of keep, pos, d1, d2) for every chunk of __t; pos packs first byte, length and half words.

    Of chunks whose digest is in hot, pos is marked, and d2 is a small number that spreads them.
    """
    narrow = docs.select(*keep, F.col("__t").cast("string").alias("__t"))
    longs = [F.lit(0).cast("bigint").alias(c) for c in ("pos", "d1", "d2")]
    schema = narrow.select(*keep, *longs).schema
    known = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hot.items()), np.int64)) if hot else None  # HOT_MOST pairs at most

    def run(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("chunks", gear.cache_clear)
        where, start, words, chunks = chunk_texts([t.encode("utf-8") for t in texts])
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), np.int64).reshape(-1, 2)
        pos, d1, d2 = start << 24 | size << 12 | words, digest[:, 0].copy(), digest[:, 1].copy()
        if known is not None:
            at = np.minimum(np.searchsorted(known.value[:, 0], d1), len(known.value) - 1)
            found = (known.value[at, 0] == d1) & (known.value[at, 1] == d2)
            pos[found] |= _HOT
            d2[found] = (where[found] + lo) % 1024
            if hot_only:
                where, pos, d1, d2 = where[found], pos[found], d1[found], d2[found]
        cols = [batch.column(c).take(pa.array(where)) for c in keep] + [pa.array(pos), pa.array(d1), pa.array(d2)]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return map_text(narrow, "__t", schema, run)


_PLACE = ["__file", "__row"]


def _repeated(rows: DataFrame, hot_least: int = HOT_LEAST, hot_share: int = HOT_SHARE) -> DataFrame:
    """Chunks found in more than one of rows (__file, __row, __id, __t): (__file, __row, pos, first, later).

    first is the id of the first row, by id, that has the chunk.  Digests that a sample
    shows to be held by many rows are grouped on their own, which merges them before
    they are shuffled; their chunks are then spread over many tasks and not
    gathered by digest.  How many there are changes the plan, never the result.
    """
    keep = [*_PLACE, "__id"]
    sample = _chunk_rows(rows.where(F.pmod(F.xxhash64(*_PLACE), F.lit(hot_share)) == 0), [])
    often = sample.groupBy("d1", "d2").count().where(F.col("count") >= hot_least).orderBy(F.desc("count"), "d1", "d2").limit(HOT_MOST)
    hot = {r.d1: r.d2 for r in often.select("d1", "d2").collect()}
    # In the order of ids, the first and the last of a digest's rows are the same only if it has no other.
    order = Window.partitionBy("d1", "d2").orderBy(F.col("__id").asc_nulls_last(), *_PLACE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{end}_{c}": f(c).over(order) for end, f in (("first", F.first), ("last", F.last)) for c in _PLACE}
    met = _chunk_rows(rows, keep, hot).withColumns(ends | {"first": F.first("__id").over(order)})
    differ = lambda a, b: (F.col(f"{a}__file") != F.col(f"{b}__file")) | (F.col(f"{a}__row") != F.col(f"{b}__row"))
    is_hot = F.col("pos").bitwiseAND(F.lit(_HOT)) != 0
    met = met.where(differ("first_", "last_") | is_hot)
    if hot:
        by = [F.struct(F.col("__id").isNull().alias("n"), "__id", *_PLACE)]
        found = _chunk_rows(rows, keep, hot, hot_only=True).groupBy("d1").agg(F.min(*by).alias("x"), F.max(*by).alias("y")).where("x.__file != y.__file or x.__row != y.__row")
        found = written(found.select(F.col("d1").alias("hot"), F.col("x.__file").alias("x_file"), F.col("x.__row").alias("x_row"), F.col("x.__id").alias("x_id")))
        met = met.join(F.broadcast(found), is_hot & (F.col("d1") == F.col("hot")), "left").where(~is_hot | F.col("hot").isNotNull())  # as many rows as hot digests
        met = met.withColumns({c: F.when(is_hot, F.col(x)).otherwise(F.col(c)) for c, x in (("first___file", "x_file"), ("first___row", "x_row"), ("first", "x_id"))})
    later = (F.col("first___file") != F.col("__file")) | (F.col("first___row") != F.col("__row"))
    return met.select(*_PLACE, F.col("pos").bitwiseAND(F.lit(_HOT - 1)).alias("pos"), "first", later.alias("later"))


def _runs(chunks: DataFrame, least_words: int, firsts: bool = False) -> DataFrame:
    """(__file, __row, start, end, half, later, parts, firsts if wanted): runs of neighbouring chunks of least_words or more.

    parts are its stretches of chunks that are all later ones or all not: arrays
    of start, end, 2 x half words + later.
    """
    columns = [*_PLACE, "pos", "later", *(["first"] if firsts else [])]
    start, size = F.shiftright("pos", 24), F.shiftright("pos", 12).bitwiseAND(4095)
    met = chunks.select(*columns).repartition(*_PLACE).withColumns({"start": start, "end": start + size, "half": F.col("pos").bitwiseAND(4095)})
    order = Window.partitionBy(*_PLACE).orderBy("start")
    fresh = F.coalesce(F.col("start") != F.lag("end").over(order), F.lit(True))
    turn = fresh | F.coalesce(F.col("later") != F.lag("later").over(order), F.lit(True))
    run = met.withColumns({"fresh": fresh.cast("int"), "turn": turn.cast("int")}).withColumns({"run": F.sum("fresh").over(order), "part": F.sum("turn").over(order)})
    firsts_of = [F.collect_set("first").alias("firsts")] if firsts else []
    part = run.groupBy(*_PLACE, "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("half").alias("half"), F.first("later").alias("later"), *firsts_of)
    packed = F.array(*[c.cast("int") for c in (F.col("start"), F.col("end"), F.col("half") * 2 + F.col("later").cast("bigint"))])
    firsts_of = [F.sort_array(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("firsts")] if firsts else []
    spans = part.groupBy(*_PLACE, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("half").alias("half"), F.max("later").alias("later"), F.collect_list(packed).alias("parts"), *firsts_of)
    return spans.where(F.col("half") >= 2 * least_words)


def _prepared(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(docs by place, with row ids; their texts and ids; where the text is)."""
    renamed, at = positional(docs)
    table = with_row_id(renamed)
    return table, table.select(*_PLACE, F.col(at(id_col)).alias("__id"), F.col(at(text_col)).cast("string").alias("__t")), at(text_col)


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages that other rows of docs have too: id_col, start_byte, end_byte, n_words, first_ids, is_later.

    A passage is a run of neighbouring chunks, each of which another row has;
    runs under least_words are left out (two characters count as a word in scripts without
    spaces).  first_ids are the ids of the rows that have its chunks first, in
    the order of ids (nulls last; of equal ids as the table lies); is_later says that
    some chunk has an earlier row.  A chunk that only one row repeats is no
    passage in this sense.

    Null and empty texts have no chunks.  Texts of any length are chunked whole.
    Rows that repeat share all their text.  Ids may be of any type that has an
    order; rows with a null id are reported with a null; first_ids leaves
    nulls out.  An empty table gives an empty table; other columns are ignored.
    """
    _, rows, _ = _prepared(docs, text_col, id_col)
    spans = _runs(_repeated(rows), least_words, firsts=True)
    named = spans.join(rows.select(*_PLACE, "__id"), _PLACE)
    return named.select(F.col("__id").alias(id_col), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.ceil(F.col("half") / 2).alias("n_words"), F.col("firsts").alias("first_ids"), F.col("later").alias("is_later"))


def _cuts(rows: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame | None]:
    """((__f, __r, cuts): by row, start, end and 2 x half words + later of every part of a passage, one after another; the rows' places).

    Places are to be broadcast, so that only texts with passages are shuffled to
    the cuts; they are None where, counted, they are too many for that.
    """
    spans = _runs(_repeated(rows), least_words)
    parts = F.flatten(F.sort_array(F.flatten(F.collect_list("parts"))))
    cuts = written(spans.groupBy(F.col("__file").alias("__f"), F.col("__row").alias("__r")).agg(parts.alias("cuts")))
    return cuts, F.broadcast(cuts.select("__f", "__r")) if cuts.count() * 16 <= BROADCAST_BYTES else None


def _at() -> Column:
    return (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))


def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """The texts less the passages that are later ones; rows without cuts as they are."""
    text, cuts = pc.cast(text, pa.large_binary()), pc.fill_null(cuts, pa.scalar([], cuts.type))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    base = offsets[0]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[base : offsets[-1]]
    offsets = offsets - base
    span = cuts.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.int64)
    row = np.repeat(np.arange(len(text)), pc.list_value_length(cuts).to_numpy(zero_copy_only=False) // 3)
    gone = span[:, 2] % 2 == 1
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offsets[row[gone]] + span[gone, 0], 1)
    np.add.at(change, offsets[row[gone]] + span[gone, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[offsets]
    out = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[kept].tobytes()), text.is_valid().buffers()[1] if text.null_count else None)
    return pc.cast(out, pa.string())


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, their texts, as strings, without what an earlier row has of passages of least_words words or more.

    Earlier is a row of lower id, nulls last; of equal ids, as the table lies: so
    one row keeps every chunk.  See repeated_spans for what a passage is.  Null
    texts stay null, empty ones empty; texts of any length are chunked whole;
    of rows that repeat all but the first lose their text, if it is long enough.
    An empty table gives an empty table.  Other columns pass through, whatever their names.
    """
    names = docs.columns
    table, rows, at = _prepared(docs, text_col, id_col)
    cuts, places = _cuts(rows, least_words)
    if places is None:
        joined = table.join(cuts, _at(), "left")
    else:
        rest = table.join(places, _at(), "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in cuts.dtypes})
        joined = table.join(places, _at(), "left_semi").join(cuts.hint("shuffle_hash"), _at()).unionByName(rest)
    joined = joined.drop("__f", "__r", *_PLACE).withColumn(at, F.col(at).cast("string"))
    schema = joined.drop("cuts").schema
    k = schema.names.index(at)

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[k] = without(columns[k], columns[-1])
            yield pa.RecordBatch.from_arrays(columns[:-1], names=schema.names)

    return joined.mapInArrow(run, schema).toDF(*names)


def cut_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that hold passages which other rows have too: id_col, passages, text_col.

    passages lists (start_byte, end_byte, n_words, is_later) in the order of the
    text as it was, a passage being parted where what an earlier row has ends; text_col is what substring_dedup() leaves of it, the whole where
    no passage is a later one.  Rows that aren't here hold no such passage.
    Odd rows are as in substring_dedup() and repeated_spans().
    """
    table, rows, at = _prepared(docs, text_col, id_col)
    cuts, places = _cuts(rows, least_words)
    some = rows if places is None else rows.join(places, _at(), "left_semi")
    joined = some.join(cuts.hint("shuffle_hash"), _at()).select("__id", "__t", "cuts")
    passage = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("is_later", T.BooleanType())])
    schema = T.StructType([T.StructField("__id", joined.schema["__id"].dataType), T.StructField("passages", T.ArrayType(passage)), T.StructField("__t", T.StringType())])

    def run(batches):
        for batch in batches:
            ids, text, cuts = batch.columns
            span = cuts.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.int64)
            parts = pa.StructArray.from_arrays([pa.array(span[:, 0]), pa.array(span[:, 1]), pa.array((span[:, 2] // 2 + 1) // 2), pa.array(span[:, 2] % 2 == 1)], names=[f.name for f in passage])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cuts).to_numpy(zero_copy_only=False) // 3)])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts), without(text, cuts)], names=schema.names)

    return joined.mapInArrow(run, schema).toDF(id_col, "passages", text_col)
