import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide import EmbeddingFunction
from vectide.errors import EngineError, SerializationError
from vectide.functions import sql, values
from vectide.functions.distance import distance, distance_to, distances
from vectide.functions.text import query_tokens, tokens
from vectide.schema import CollectionConfig, index_name, metric_name

CASES = [
    ("cosine", [1, 2, 3], [4, 5, 6], 1 - 32 / math.sqrt(1078)),
    ("cosine", [1, 0], [-1, 0], 2.0),
    ("cosine", [0, 0], [1, 1], 1.0),
    ("cosine", [1, 1], [0, 0], 1.0),
    ("cosine", [1, 2], [10, 20], 0.0),
    ("euclidean", [1, 2, 3], [4, 5, 6], math.sqrt(27)),
    ("l2", [1, 1], [1, 1], 0.0),
    ("dot", [1, 2, 3], [4, 5, 6], -32.0),
    ("ip", [1, 0], [0, 1], 0.0),
]


@pytest.mark.parametrize("metric, a, b, expected", CASES)
def test_distances(spark, metric, a, b, expected):
    a, b = [float(x) for x in a], [float(x) for x in b]
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = df.select(distance_to(F.col("a"), b, metric), distance(F.col("a"), F.col("b"), metric), distance(F.col("a"), F.col("b"), metric, len(a)), distance(F.col("b"), F.col("a"), metric)).first()
    assert all(x == pytest.approx(expected, abs=1e-6) for x in row)
    assert distances(np.array([a]), np.array([b]), metric_name(metric))[0, 0] == pytest.approx(expected, abs=1e-6)


def test_long_vectors_and_the_triangle_inequality(spark):
    rng = np.random.default_rng(1)
    x, y, z = (rng.normal(size=300).astype(np.float32).tolist() for _ in range(3))
    df = spark.createDataFrame([(x, y)], "a array<float>, b array<float>")
    for metric in ("cosine", "euclidean", "dot"):
        one, two = df.select(distance_to(F.col("a"), y, metric), distance(F.col("a"), F.col("b"), metric)).first()
        assert one == pytest.approx(two) == pytest.approx(distances(np.array([x]), np.array([y]), metric)[0, 0])
    d = lambda a, b: distances(np.array([a]), np.array([b]), "euclidean")[0, 0]
    assert d(x, z) <= d(x, y) + d(y, z)


def test_names():
    assert [metric_name(m) for m in ("COSINE", "L2", "Euclidean", "dot", "dot_product", "DotProduct", "ip")] == ["cosine", "euclidean", "euclidean", "dot", "dot", "dot", "dot"]
    assert index_name("HNSW") == "hnsw"
    for bad in (lambda: metric_name("manhattan"), lambda: index_name("tree"), lambda: CollectionConfig("a/b", 3), lambda: CollectionConfig("..", 3), lambda: CollectionConfig("a", 0)):
        with pytest.raises(EngineError):
            bad()
    with pytest.raises(ValueError, match="metric: 'x'"):
        metric_name("x")


def test_tokens(spark):
    text = "Hello, World! This is a test. Élan é 中 x_y"
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(tokens(F.col("t"))).collect()
    assert found[0][0] == ["hello", "world", "this", "is", "test", "élan", "é", "中"] == query_tokens(text)
    assert found[1][0] == [] and found[2][0] is None
    for text in ("हिन्दी भाषा", "ภาษาไทย", "İstanbul ǅ", "a\u0300b ½ x² ⅷ", "_ - '"):
        assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == query_tokens(text)


def test_json_values(spark):
    items = [1, 1.0, "1", True, None, 1.5, 2**70, [1, 1.0], {"b": 1, "a": [None]}, "x", False, 0, ""]
    df = spark.createDataFrame([(k, values.encode(v)) for k, v in enumerate(items)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    for i, wanted in enumerate(items):
        equal = [r[0] for r in df.where(values.same(F.col("v"), wanted)).select("k").orderBy("k").collect()]
        assert equal == [k for k, v in enumerate(items) if v == wanted and type(v) is type(wanted) and (not isinstance(v, list) or [type(x) for x in v] == [type(x) for x in wanted])]
    for bad in (float("nan"), (1, 2), {1: 2}, object()):
        with pytest.raises(SerializationError):
            values.encode(bad)


def test_sql_functions(spark):
    assert "cosine_distance" in sql.register(spark)
    row = spark.sql("SELECT cosine_distance(array(1f, 0f), array(0f, 0f)), euclidean_distance(array(0f, 3f), array(4f, 0f)), dot_distance(array(1f, 2f), array(3f, 4f)), keyword_tokens('A big Cat')").first()
    assert tuple(row) == (1.0, 5.0, -11.0, ["big", "cat"])


def test_embedding_column(spark):
    class Lengths(EmbeddingFunction):
        def embed(self, parts):
            return [(float(len(t)), 1.0) for t in parts]

    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(Lengths().column(F.col("t"), 2)).collect()] == [[3.0, 1.0], None, [0.0, 1.0]]
