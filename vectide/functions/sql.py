"""The functions under names that SQL can call; their bodies are SQL, so that the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0D, (s, t) -> s + t)"


def register(spark: SparkSession) -> list[str]:
    """Creates temporary functions and returns their names: three distances and tokens(text)."""

    def total(a: str, b: str, term: str) -> str:
        return _SUM.format(a=a, b=b, term=term)

    inner, norm_a, norm_b = (total(a, b, "double(x) * double(y)") for a, b in (("a", "b"), ("a", "a"), ("b", "b")))
    bodies = {
        "cosine_distance": f"CASE WHEN sqrt({norm_a}) * sqrt({norm_b}) = 0 THEN 1D ELSE 1 - {inner} / (sqrt({norm_a}) * sqrt({norm_b})) END",
        "euclidean_distance": f"sqrt({total('a', 'b', '(double(x) - double(y)) * (double(x) - double(y))')})",
        "dot_distance": f"-{inner}",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION keyword_tokens(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(t), r'[^\p{IsAlphabetic}\p{N}]+'), x -> octet_length(x) > 1)")
    return [*bodies, "keyword_tokens"]
