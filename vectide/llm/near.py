"""Pairs of like documents by min-wise hashing: bands grouped in Spark, candidates told apart by signatures, then by texts.

What operators 7 and 10 share.  Signatures are made once and carried.  Of every
bucket, the rows that agree in a band, all are compared with the first by
signatures; rows of different components that this leaves in a bucket are
compared with one another.  So only rows whose signatures say that they may be
alike come together, once each, to have their texts compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import claim, map_text, sized, with_row_id, written
from .byte_bpe import _gather
from .components import components
from .shingles import band_keys, forget_powers, jaccard, mix64, shingle_sets, shingles, signatures

#: Documents, and their words, that meet in one task at most; what is more is parted into blocks.
BLOCK_DOCS = 8_000
BLOCK_WORDS = 4_000_000
#: Documents of small groups that are checked in one call.
CALL_DOCS = 2_000


@dataclass(frozen=True)
class Likeness:
    """threshold: least Jaccard similarity of the texts' runs of `width` words; bands of `rows` min-wise hashes."""

    threshold: float
    bands: int
    rows: int
    width: int = 2
    seed: int = 11
    #: Sequential Bayesian verification, in batches of so many hashes, at this probability of missing a pair.
    batch: int = 30
    miss: float = 0.01
    #: Pairs whose documents are already joined are not checked again.
    forest: bool = False

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def limits(self) -> list[tuple[int, int]]:
        """(hashes looked at, fewest that must be equal) after every batch."""
        return [(n, least_matches(n, self.threshold, self.miss)) for n in range(self.batch, self.hashes + 1, self.batch)]


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n equal hashes with which a pair's similarity is at least threshold with probability >= miss.

    With a uniform prior, similarity after m of n matches is Beta(m + 1, n - m + 1);
    its upper tail at t is the chance of at most m successes among n + 1 trials of t.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def pruned(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (i, j) may be alike, batch of hashes by batch."""
    alive, matches, at = np.arange(len(j)), np.zeros(len(j), np.int64), 0
    for n, least in limits:
        if not len(alive):
            break
        for lo in range(0, len(alive), 20_000):
            some = alive[lo : lo + 20_000]
            matches[some] += np.count_nonzero(sigs[j[some], at:n] == sigs[i[some], at:n], axis=1)
        alive, at = alive[matches[alive] >= least], n
    return alive


def candidate_rows(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i that share a band with i) for each i that has any."""
    n, bands = keys.shape
    orders, place, stop = [], np.zeros((bands, n), np.int64), np.zeros((bands, n), np.int64)
    for b in range(bands):
        order = np.argsort(keys[:, b], kind="stable")
        col = keys[order, b]
        edges = np.append(np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])), n)
        orders.append(order)
        place[b, order] = np.arange(n)
        stop[b, order] = np.repeat(edges[1:], np.diff(edges))
    for i in np.flatnonzero((stop - place > 1).any(axis=0)).tolist():
        found = [orders[b][place[b, i] + 1 : stop[b, i]] for b in range(bands) if stop[b, i] - place[b, i] > 1]
        yield i, found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def check_group(keys: np.ndarray, sigs: np.ndarray, texts: list[str] | None, how: Likeness, side: np.ndarray | None = None, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Jaccard) of the rows that share a key and are alike: by their texts, or, without texts, by their signatures.

    Where side isn't -1 only pairs across the sides are looked at.  With how.forest, or
    without texts, rows that are joined already, or whose class is one, are not looked at again.
    """
    n = len(keys)
    forest = how.forest or texts is None
    parent = np.arange(n)
    if classes is not None:
        _, first, back = np.unique(classes, return_index=True, return_inverse=True)
        parent = first[back].astype(np.int64)
    if texts is not None:
        values, counts = shingles(texts, how.width)
        sets = [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        marked = np.zeros(len(vocabulary), np.int32)
    limits = how.limits
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, js in candidate_rows(keys):
        if side is not None:
            js = js[(side[js] < 0) | (side[js] != side[i])]
        if texts is not None:  # |a & b| / |a | b| is at most the smaller size over the larger
            js = js[np.minimum(sizes[js], sizes[i]) >= how.threshold * np.maximum(sizes[js], sizes[i])]
        if forest and len(js):
            while not np.array_equal(hop := parent[parent], parent):
                parent = hop
            js = js[parent[js] != parent[i]]
        if len(js):
            js = js[pruned(sigs, np.full(len(js), i), js, limits)]
        if not len(js):
            continue
        if texts is not None:
            mine = flat[starts[i] : starts[i] + sizes[i]]
            marked[mine] = 1
        if forest:  # one at a time, since each may join the others
            near, same = [], []
            for j in js.tolist():
                a, b = parent[i], parent[j]
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a == b:
                    continue
                s = 0 if texts is None else int(marked[flat[starts[j] : starts[j] + sizes[j]]].sum())
                if texts is None or s >= how.threshold * (sizes[i] + sizes[j] - s):
                    parent[max(a, b)] = min(a, b)
                    near.append(j)
                    same.append(s)
            js, shared = np.array(near, np.int64), np.array(same, np.int64)
        else:
            hit = marked[_gather(starts[js], sizes[js], flat)]
            shared = np.add.reduceat(hit, np.cumsum(sizes[js]) - sizes[js])
        if texts is not None:
            marked[mine] = 0
            union = sizes[i] + sizes[js] - shared
            good = shared >= how.threshold * union
            js, shared = js[good], shared[good] / union[good]
        if len(js):
            out.append((np.full(len(js), i), js, np.asarray(shared, np.float64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], most: int = CALL_DOCS, words: str | None = None, most_words: int = BLOCK_WORDS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of the group of each): whole groups of equal `names`, as many small ones at once as make `most` rows."""
    held: list[pa.Table] = []
    sizes: list[int] = []
    last, weight = None, 0

    def out() -> tuple[pa.Table, np.ndarray]:
        return pa.concat_tables(held), np.repeat(np.arange(len(sizes)), sizes)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cols = [table.column(n).to_numpy() for n in names]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        each = table.column(words).to_numpy() if words else None
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo].item() for c in cols)
            if key != last:
                if held and (sum(sizes) >= most or weight >= most_words // 8):
                    yield out()
                    held, sizes, weight = [], [], 0
                sizes.append(0)
            last = key
            held.append(table.slice(lo, hi - lo))
            sizes[-1] += hi - lo
            weight += int(each[lo:hi].sum()) if words else 0
    if held:
        yield out()


def _matrix(column: pa.ChunkedArray | pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, hashes)


def _meet(members: DataFrame, payload: DataFrame, by: list[str], schema: str, check: Callable) -> DataFrame:
    """check over the members' payload, joined by nid; members of one `by` come together, in the order of nid."""
    joined = payload.join(sized(written(members), 48), "nid").repartition(*by).sortWithinPartitions(*by, "nid")
    return written(joined.mapInArrow(check, schema))


def _around(edges: DataFrame, most: int) -> DataFrame:
    """(a, part, nid): every a with its b's, in parts of `most` rows at most, each of which has a as well."""
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    own = edges.join(sized(written(parts), 16), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("nid"))
    return own.union(parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("nid")))


def _across(members: DataFrame, most: int, weight: Column | None = None, most_weight: int = BLOCK_WORDS) -> DataFrame:
    """(g, p, q, nid, side, class): tasks in which every two rows of g of different classes meet; members: (g, nid, class).

    The largest class of g, parted into blocks, meets blocks of the others,
    which meet one another: rows of a class that holds most of a group are
    sent as often as there are blocks of others, which is once as a rule.
    """
    weight = F.lit(0) if weight is None else weight
    per = members.groupBy("g", "class").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    top = per.groupBy("g").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max(F.struct("n", "class", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(w / most_weight)).cast("int")
    top = top.select("g", "main", blocks(F.col("m.n"), F.col("m.w")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("others"))
    rows = members.join(sized(written(top), 32), "g").withColumn("is_main", F.col("class") == F.col("main"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("nid"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    task = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    k = F.col("k")
    main = F.transform(upto("others"), lambda x: task(-k - 1, x, F.lit(0)))
    other = F.concat(
        F.transform(upto("mains"), lambda x: task(-x - 1, k, F.lit(1))),
        F.transform(upto("others"), lambda x: task(F.least(k, x), F.greatest(k, x), F.when(k == x, -1).otherwise((k > x).cast("int")))),
    )
    return rows.select("g", "nid", "class", F.explode(F.when(F.col("is_main"), main).otherwise(other)).alias("t")).select("g", "t.p", "t.q", "nid", "t.side", "class")


@dataclass(frozen=True)
class Found:
    """table: docs with row ids; rows: (nid, __file, __row, columns kept, sig).

    same: (a, b), b a row of the same words as a, the first such; found: what was
    made of the verified pairs of rows that stand for themselves.
    """

    table: DataFrame
    rows: DataFrame
    same: DataFrame
    found: DataFrame


_PAIRS = "a bigint, b bigint, jaccard double"


def like_documents(docs: DataFrame, text_col: str, how: Likeness, keep: list[str] = (), links: bool = False, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> Found:
    """Verified pairs of rows of docs; rows of the same words are linked to the first of them, which stands for all.

    found has (a, b, jaccard), a < b: all pairs, or, with how.forest, as many as
    join what belongs together.  With links it has (nid, links, most): how many others each
    is like, and the greatest similarity.
    """
    table = with_row_id(docs)
    text = F.col(f"`{text_col}`").cast("string")
    narrow = table.select("__file", "__row", *keep, text.alias("__text"))
    names = ["__file", "__row", *keep]
    longs = [F.lit(0).cast("bigint").alias(c) for c in ("w1", "w2", "words")]
    schema = narrow.select(*names, *longs, F.lit(b"").alias("sig")).schema

    def digest(batch: pa.RecordBatch, lo: int, texts: list[str]) -> pa.RecordBatch:
        claim("near", forget_powers)
        values, counts = shingles(texts, how.width)
        sigs = signatures(values, counts, how.hashes, how.seed)
        place = np.arange(len(values), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
        whole = []
        for salt in (1, 2):  # two sums over (shingle, place), so that equal texts are known by 128 bits
            mixed = mix64(values ^ mix64(place * np.uint64(2) + np.uint64(salt)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
            ends = np.cumsum(counts)
            whole.append(pa.array((total[ends] - total[ends - counts]).view(np.int64)))
        prints = pa.array([s.tobytes() if c else b"" for s, c in zip(sigs, counts)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in names] + whole + [pa.array(counts), prints], names=[f.name for f in schema])

    rows = written(map_text(narrow, "__text", schema, digest).withColumn("nid", F.monotonically_increasing_id()))
    # Rows of the very same words: one stands for all.
    some = rows.where("words > 0")
    twice = some.groupBy("w1", "w2").agg(F.min("nid").alias("a"), F.count("*").alias("n")).where("n > 1")
    same = written(some.select("w1", "w2", "nid").join(sized(written(twice), 24), ["w1", "w2"]).where("nid > a").select("a", F.col("nid").alias("b")))
    alone = some.join(sized(same.select(F.col("b").alias("nid")), 8), "nid", "left_anti")
    # Buckets of two rows and more, with their first; only the rows in them are looked at from here on.
    width = 4 * how.rows
    keys = F.array(*[F.xxhash64(F.substring("sig", b * width + 1, width), F.lit(b)) for b in range(how.bands)])
    buckets = alone.select("nid", F.explode(keys).alias("key"))
    shared = buckets.groupBy("key").agg(F.min("nid").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    shared = written(buckets.join(sized(written(shared), 16), "key"))
    here = sized(written(shared.select("nid").distinct()), 8)
    payload = written(rows.select("nid", "__file", "__row", "words", "sig").join(here, "nid"))
    star = written(shared.where("nid > a").select("a", F.col("nid").alias("b")).distinct())
    prints = payload.select("nid", "sig")
    edges = _meet(_around(star, block_docs), prints, ["a", "part"], "a bigint, b bigint", _star_check(how))
    # What the firsts don't tell: rows of a bucket that are in different components by now.
    root = components(edges)
    marked = shared.where("nid > a").select("key", "nid").join(sized(written(root), 16), F.col("nid") == F.col("node"), "left")
    marked = written(marked.select(F.col("key").alias("g"), "nid", F.coalesce("root", "nid").alias("class")))
    open_ = marked.groupBy("g").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("g")
    rest = _across(marked.join(sized(written(open_), 8), "g"), block_docs)
    more = _meet(rest, prints, ["g", "p", "q"], "a bigint, b bigint", _bucket_check(how))
    edges = edges.union(more)
    # Texts meet by components.
    parts = written(components(edges))
    member = written(parts.join(payload.select(F.col("nid").alias("node"), "words"), "node"))
    blocks = written(member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("words") / block_words)).cast("int").alias("blocks")))
    large = blocks.where("blocks > 1")
    placed = payload.select("nid", F.col("__file").alias("__f"), F.col("__row").alias("__r"), "words")

    def texts_of(members: DataFrame, by: list[str], out: str, check: Callable, signed: bool = True) -> DataFrame:
        """check over the members' texts and, in rows of their own, signatures: so neither is shuffled but to its task."""
        at = written(placed.join(sized(written(members), 48), "nid"))
        place = (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))
        met = table.select("__file", "__row", text.alias("__text")).join(sized(at, 64), place).drop("__file", "__row", "__f", "__r").withColumn("sig", F.lit(None).cast("binary"))
        if signed:
            met = met.unionByName(prints.join(sized(at, 64), "nid").drop("__f", "__r").withColumn("__text", F.lit(None).cast("string")))
        return written(met.repartition(*by).sortWithinPartitions(*by, "nid").mapInArrow(check, out))

    schema_out = "nid bigint, links bigint, most double" if links else _PAIRS
    task = [F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(-1).alias("side"), F.lit(None).cast("bigint").alias("class")]
    whole = member.join(sized(blocks.where("blocks = 1"), 16), "root").select(F.col("root").alias("g"), F.col("node").alias("nid"), *task)
    check = _text_check(how, links)
    by = ["g", "p", "q"]
    if large.isEmpty():
        return Found(table, rows, same, texts_of(whole, by, schema_out, check))
    if not how.forest:  # all pairs are wanted: block meets block
        block = member.join(sized(large, 16), "root").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("k") == F.col("o"), -1).otherwise((F.col("k") > F.col("o")).cast("int"))
        squared = block.select(F.col("root").alias("g"), F.col("node").alias("nid"), F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"), side.alias("side"), task[3])
        return Found(table, rows, same, texts_of(whole.union(squared), by, schema_out, check))
    found = texts_of(whole, by, _PAIRS, check)
    inside = member.join(sized(large, 16), "root").select(F.col("root").alias("g"), F.col("node").alias("nid"), "words")
    within = edges.join(sized(written(inside.select(F.col("nid").alias("a"))), 8), "a")
    sure = texts_of(_around(within, min(block_docs, 1000)), ["a", "part"], _PAIRS, _edge_check(how), signed=False)
    joined = written(components(sure.select("a", "b")))
    classes = written(inside.join(sized(joined, 16), F.col("nid") == F.col("node"), "left").select("g", "nid", "words", F.coalesce("root", "nid").alias("class")))
    torn = written(classes.groupBy("g").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("g"))
    last = texts_of(_across(classes.join(sized(torn, 8), "g"), block_docs, F.col("words"), block_words), by, _PAIRS, check)
    return Found(table, rows, same, found.union(sure).union(last))


def _star_check(how: Likeness) -> Callable:
    """Each part's first row against the others, by signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, first, print_ = how.limits, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, nid, sigs = batch.column("a").to_numpy(), batch.column("nid").to_numpy(), _matrix(batch.column("sig"), how.hashes)
            if first is not None:  # a part may go on from one batch to the next
                a, nid, sigs = np.append(first, a), np.append(first, nid), np.concatenate([print_[None], sigs])
            leads = a == nid
            at = np.maximum.accumulate(np.where(leads, np.arange(len(a)), 0))
            others = np.flatnonzero(~leads)
            good = others[pruned(sigs, at[others], others, limits)]
            first, print_ = a[at[-1]], sigs[at[-1]].copy()
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(nid[good])], names=["a", "b"])

    return run


def _bucket_check(how: Likeness) -> Callable:
    """Rows of a bucket that are in different components, by signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, own in _runs(batches, ["g", "p", "q"]):
            nid = group.column("nid").to_numpy()
            # The class is known within a group; other groups may hold it too.
            i, j, _ = check_group(own.astype(np.uint64)[:, None], _matrix(group.column("sig"), how.hashes), None, how, group.column("side").to_numpy(), group.column("class").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nid[i], nid[j])), pa.array(np.maximum(nid[i], nid[j]))], names=["a", "b"])

    return run


def _text_check(how: Likeness, links: bool) -> Callable:
    """Rows of a component that share a band, by signatures and then by texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", forget_powers)
        for group, own in _runs(batches, ["g", "p", "q"], words="words"):
            signed = group.column("sig").is_valid()
            sigs = _matrix(group.column("sig").filter(signed), how.hashes)
            unsigned = pc.invert(signed)
            own, group = own[unsigned.to_numpy()], group.filter(unsigned)  # both kinds of rows are in one order
            nid = group.column("nid").to_numpy()
            keys = band_keys(sigs, how.bands) ^ mix64(own.astype(np.uint64))[:, None]
            classes = group.column("class")
            i, j, s = check_group(keys, sigs, group.column("__text").to_pylist(), how, group.column("side").to_numpy(), None if classes.null_count else classes.to_numpy())
            if links:
                n, most = np.bincount(i, minlength=len(nid)) + np.bincount(j, minlength=len(nid)), np.zeros(len(nid))
                np.maximum.at(most, i, s)
                np.maximum.at(most, j, s)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(nid[some]), pa.array(n[some]), pa.array(most[some])], names=["nid", "links", "most"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nid[i], nid[j])), pa.array(np.maximum(nid[i], nid[j])), pa.array(s)], names=["a", "b", "jaccard"])

    return run


def _edge_check(how: Likeness) -> Callable:
    """Each part's first row against the others, by texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", forget_powers)
        for group, own in _runs(batches, ["a", "part"], words="words"):
            nid, a = group.column("nid").to_numpy(), group.column("a").to_numpy()
            sets = shingle_sets(group.column("__text").to_pylist(), how.width)
            at = np.maximum.accumulate(np.where(a == nid, np.arange(len(a)), 0))
            s = np.array([jaccard(sets[k], sets[j]) if j != k else 0.0 for j, k in enumerate(at.tolist())])
            good = s >= how.threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(nid[good]), pa.array(s[good])], names=["a", "b", "jaccard"])

    return run
