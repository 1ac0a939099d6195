"""Operator 2, mixing sources to target weights: budgets in tokens, fitted by bounded subset sums over lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import claim, map_text, positional, sized, with_row_id, written
from .bpe import DEFAULT_VOCAB, forget_tiktoken, ship_vocab, tiktoken_ids

#: Tokens of every source's budget that the dynamic program fits; the rest is taken evenly from all lengths.
DP_TOKENS = 1 << 15


def shares(totals: dict[str, int], weights: dict[str, float] | None, budget: int) -> dict[str, int]:
    """Tokens to take of each source: in proportion to weights; what a source lacks goes to the others likewise.

    Sources without a weight get none; without weights all weigh the same.
    """
    weight = {s: 1.0 if weights is None else max(0.0, float(weights.get(s, 0.0))) for s in totals}
    open_, out, left = {s for s in totals if weight[s] > 0 and totals[s] > 0}, dict.fromkeys(totals, 0), int(budget)
    while open_ and left > 0:
        whole = sum(weight[s] for s in open_)
        short = {s for s in open_ if totals[s] <= left * weight[s] / whole}
        if not short:
            for s in open_:
                out[s] = int(left * weight[s] / whole)
            break
        for s in sorted(short):
            out[s] = totals[s]
            left -= totals[s]
        open_ -= short
    return out


def fit_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_tokens: int = DP_TOKENS) -> np.ndarray:
    """How many documents of each length to take, so that their tokens come as near under budget as can be.

    All but dp_tokens of the budget are taken evenly from all lengths, longest
    first, each passing its remainder on.  The rest is an exact bounded
    knapsack over the lengths left, a set of reachable sums held as the bits of
    an integer.
    """
    order = np.argsort(-lengths, kind="stable")
    lens, have = lengths[order].astype(object), counts[order].astype(object)
    whole = int(sum(l * c for l, c in zip(lens, have)))
    take = [0] * len(lens)
    if budget >= whole:
        out = counts.copy()
        return out
    even = max(0, budget - dp_tokens)
    carry = 0  # in units of tokens x whole
    for i, (l, c) in enumerate(zip(lens, have)):
        if l <= 0:
            continue
        carry += even * l * c
        take[i] = int(min(c, carry // (l * whole)))
        carry -= take[i] * l * whole
    left = budget - sum(t * l for t, l in zip(take, lens))
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in range(len(lens) - 1, -1, -1):  # shortest first
        spare, l, part = have[i] - take[i], int(lens[i]), 1
        if l <= 0:
            take[i] = have[i]
            continue
        if l > left:
            break
        spare = min(spare, left // l)
        while spare > 0 and not reach >> left & 1:
            k = min(part, spare)
            after = (reach | reach << (k * l)) & mask
            if after != reach:
                steps.append((i, k, reach))
                reach = after
            spare -= k
            part *= 2
    best = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            take[i] += k
            best -= k * int(lens[i])
    out = np.zeros(len(lens), np.int64)
    out[order] = np.array(take, np.int64)
    return out


def _with_tokens(docs: DataFrame, text_col: str, vocab: str, column: str, drop: bool) -> DataFrame:
    raw = ship_vocab(docs.sparkSession, vocab)
    names = [c for c in docs.columns if not (drop and c == text_col)]
    schema = docs.select(*names, F.lit(0).cast("bigint").alias(column)).schema

    def run(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("tiktoken", forget_tiktoken)
        n = pa.array([len(tiktoken_ids(t, raw.value)) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], n], names=[*names, column])

    return map_text(docs, text_col, schema, run)


def _cut_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(columns of by, value, take, n): the value at which `take` of a group's n rows, in the order of `value`, are reached.

    take and n, columns of rows, come back as how many of the n rows with that very
    value are to be taken.  Values, which are hashes, are counted by ranges
    first, as many as give some 256 rows each, and 65,536 at most, so that only one
    range of a group is ordered, and a group of any size is counted by many tasks.
    """
    bits = F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / 256)))).cast("int")
    # Shifted by what depends on the group: a power of two as divisor does the same.
    ranged = rows.select(*by, value, "take", F.floor(F.col(value) / F.pow(F.lit(2.0), 64 - bits)).cast("bigint").alias("__range"))
    ranges = ranged.groupBy(*by, "take", "__range").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*by).orderBy("__range"))
    cut = ranges.withColumn("before", up_to - F.col("n")).where("before < take and take <= before + n").select(*by, "__range", (F.col("take") - F.col("before")).alias("take"))
    inside = ranged.drop("take").join(sized(written(cut), 64), [*by, "__range"])
    values = inside.groupBy(*by, "take", F.col(value).alias("value")).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*by).orderBy("value"))
    found = values.withColumn("before", up_to - F.col("n")).where("before < take and take <= before + n")
    return written(found.select(*by, "value", (F.col("take") - F.col("before")).alias("take"), "n"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_tokens: int | None = None,
    budget_fraction: float = 0.6,
    seed: int = 7,
    text_col: str = "text",
    source_col: str = "source",
    vocab: str = DEFAULT_VOCAB,
    dp_tokens: int = DP_TOKENS,
    with_counts: bool = False,
    drop_text: bool = False,
    key_cols: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """The rows of docs to train on, so that each source has its weight's share of the tokens.

    The budget is budget_tokens, or budget_fraction of the table's tokens.
    shares() divides it, equally without weights; fit_subset() says how many
    documents of each exact length a source gives; those of the least seeded
    hash of key_cols are taken, equal ones by a hash of their place.  Returns
    docs' columns (and n_tokens, with_counts; without the text, with drop_text).

    A null source is a source of its own, 'null' among weights.  Null and empty
    texts have no tokens: they cost nothing and are kept where their source has
    any share.  Texts of any length are counted whole.  Repeated rows are each a
    document; ids may be of any type.  An empty table gives an empty table.
    Other columns pass through, however they are called.
    """
    names = docs.columns
    renamed, place_of = positional(docs)
    text_at = place_of(text_col)
    text, source = F.col(text_at).cast("string"), F.coalesce(F.col(place_of(source_col)).cast("string"), F.lit("null"))
    keys = [F.col(place_of(k)) for k in key_cols]
    base = renamed.select(
        *renamed.columns,
        *([] if dict(renamed.dtypes)[text_at] == "string" else [text.alias("__text")]),
        source.alias("__source"),
        F.xxhash64(*keys, F.lit(seed)).alias("__hash"),
    )
    at = "__text" if "__text" in base.columns else text_at
    table = with_row_id(written(_with_tokens(base, at, vocab, "__tokens", drop_text or at == "__text")))
    hist = table.groupBy("__source", "__tokens").agg(F.count("*").alias("n"))
    hist = written(hist)
    totals = {r[0]: (int(r[1]), int(r[2])) for r in hist.groupBy("__source").agg(F.sum(F.col("__tokens") * F.col("n")), F.sum("n")).collect()}
    amount = {s: t for s, (t, _) in totals.items()}
    budget = int(sum(amount.values()) * budget_fraction) if budget_tokens is None else int(budget_tokens)
    share = shares(amount, weights, budget)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["__source"].iloc[0]
        lens, have = pdf["__tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        take = fit_subset(lens, have, share.get(name, 0), dp_tokens)
        if weights is not None and weights.get(name, 0) <= 0:
            take[:] = 0
        return pd.DataFrame({"__source": pdf["__source"], "__tokens": lens, "take": take, "n": have})

    plan = written(hist.groupBy("__source").applyInPandas(fit, "__source string, __tokens bigint, take bigint, n bigint"))
    # Per source and length: all, none, or those up to the last (hash, hash of the place) that is taken.
    narrow = table.select("__source", "__tokens", "__hash", F.xxhash64("__file", "__row").alias("__at"))
    some = plan.where("take > 0 and take < n").select("__source", "__tokens", "take", "n")
    length = ["__source", "__tokens"]
    last = _cut_values(narrow.join(sized(written(some), 64), length), length, "__hash").withColumnRenamed("value", "last")
    torn = last.where("take < n")  # only rows that repeat have equal hashes
    within = narrow.join(sized(written(torn), 72), length).where("__hash = last").select(*length, "__at", "take", "n")
    last = last.select(*length, "last").join(_cut_values(within, length, "__at").select(*length, F.col("value").alias("last_at")), length, "left")
    rule = plan.where("take > 0").join(last, length, "left").select(*length, "last", "last_at", (F.col("take") == F.col("n")).alias("every"))
    rule = sized(written(rule), 72)
    place = F.xxhash64("__file", "__row")
    taken = F.col("every") | (F.col("__hash") < F.col("last")) | ((F.col("__hash") == F.col("last")) & (F.col("last_at").isNull() | (place <= F.col("last_at"))))
    picked = table.join(rule, length).where(taken)
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if not (with_counts and c == "n_tokens" or drop_text and f"c{i}" == text_at)]
    return picked.select(*out, *([F.col("__tokens").alias("n_tokens")] if with_counts else []))
