import itertools
import random

import pytest
from pyspark.sql import functions as F

from vectide.errors import InvalidFilter
from vectide.functions import values
from vectide.operators import filters

ROWS = [{"price": 10, "color": "red"}, {"price": 10.0}, {"price": "10"}, {}, {"price": 50, "color": "blue", "a.b": True}, {"price": None, "tags": [1, 2]}, {"it's?": 1, "price": True}, {"price": -3, "nest": {"a": 1}}]
MISSING = object()


def same(a, b):
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def passes(spec, row):
    """The language, in plain Python."""
    ok = True
    for key, body in spec.items():
        if key == "$and":
            ok &= all(passes(p, row) for p in body)
        elif key == "$or":
            ok &= any(passes(p, row) for p in body)
        else:
            v = row.get(key, MISSING)
            for op, x in (body if isinstance(body, dict) else {"$eq": body}).items():
                eq = v is not MISSING and op in ("$eq", "$ne") and same(v, x)
                within = v is not MISSING and op in ("$in", "$nin") and any(same(v, y) for y in x)
                number = all(isinstance(y, (int, float)) and not isinstance(y, bool) for y in (v, x))
                both = number or (isinstance(v, str) and isinstance(x, str))
                ok &= {"$eq": eq, "$ne": not eq, "$in": within, "$nin": not within, "$gt": both and v > x, "$gte": both and v >= x, "$lt": both and v < x, "$lte": both and v <= x}[op] if op not in ("$gt", "$gte", "$lt", "$lte") or both else False
    return ok


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(k, values.encode(r)) for k, r in enumerate(ROWS)], "k int, j string").select("k", F.parse_json("j").alias("metadata")).cache()


def found(data, spec):
    return [r[0] for r in filters.where(data, spec).select("k").orderBy("k").collect()]


CASES = [{"price": {op: x}} for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") for x in (10, 10.0, "10", None, True)]
CASES += [{"price": {op: x}} for op in ("$in", "$nin") for x in ([], [10, "10"], [None, 50.0])]
CASES += [{}, {"price": {}}, {"$and": []}, {"$or": []}, {"a.b": True}, {"it's?": 1}, {"tags": [1, 2]}, {"tags": [1, 2.0]}, {"nest": {"$eq": {"a": 1}}}, {"$eq": 1}]
CASES += [{"price": {"$gte": 5, "$lt": 50}, "color": "red"}, {"$or": [{"color": "blue"}, {"$and": [{"price": 10}, {"color": {"$ne": "blue"}}]}]}]


def test_every_operator(data):
    for spec in CASES:
        assert found(data, spec) == [k for k, r in enumerate(ROWS) if passes(spec, r)], spec


def test_random_filters(data):
    rng = random.Random(3)
    leaf = lambda: {rng.choice(["price", "color", "no"]): {rng.choice(["$eq", "$ne", "$gt", "$lte"]): rng.choice([10, 10.0, "red", "10", None])}}
    for _ in range(15):
        spec = {rng.choice(["$and", "$or"]): [leaf(), {rng.choice(["$and", "$or"]): [leaf(), leaf()]}]}
        assert found(data, spec) == [k for k, r in enumerate(ROWS) if passes(spec, r)], spec


def test_typed_columns_agree_and_are_pushed_down(spark, tmp_path):
    rows = [(1, "en", 5, 1.5, True), (2, "de", None, None, None), (3, None, 7, 2.0, False)]
    spark.createDataFrame(rows, "id int, lang string, n bigint, x double, b boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = {r[0]: {k: v for k, v in zip(("lang", "n", "x", "b"), r[1:]) if v is not None} for r in rows}
    fields = filters.TypedFields(df)
    for f, op, x in itertools.product(("lang", "n", "x", "b", "none"), ("$eq", "$ne", "$gt", "$lte"), (5, 2.0, "en", True, None)):
        got = sorted(r[0] for r in df.where(filters.compile({f: {op: x}}, fields)).collect())
        assert got == [i for i, r in plain.items() if passes({f: {op: x}}, r)], (f, op, x)
    plan = df.where(filters.compile({"n": {"$gt": 5}}, fields))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan


@pytest.mark.parametrize("bad", [1, [], {"$and": {}}, {"$or": 1}, {"a": {"$in": 1}}, {"a": {"$nin": "x"}}, {"a": {"$regex": "x"}}, {"a": {"b": 1}}])
def test_bad_filters(bad):
    with pytest.raises(InvalidFilter):
        filters.parse(bad)
