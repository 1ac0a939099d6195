"""JSON values as Spark's VARIANT, told apart by type: 1, 1.0 and "1" are three values."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SerializationError

_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def encode(value: Any) -> str:
    """JSON in which floats, and integers beyond 64 bits, have an exponent, so that VARIANT keeps them as doubles."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value) if -(1 << 63) <= value < 1 << 63 else encode(float(value))
    if isinstance(value, float):
        if not math.isfinite(value):
            raise SerializationError("a number that is not finite has no JSON form")
        text = repr(value)
        return text if "e" in text else text + "e0"
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise SerializationError("keys of JSON objects must be strings")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{encode(v)}" for k, v in value.items()) + "}"
    raise SerializationError(f"unsupported type for JSON conversion: {type(value).__name__}")


def field(metadata: Column, name: str) -> Column:
    """The value of a top-level key, dots included; NULL where the key is missing."""
    if "'" not in name and "?" not in name and name:
        return F.variant_get(metadata, f"$['{name}']", "variant")
    return F.try_element_at(metadata.cast("map<string,variant>"), F.lit(name))


def same(value: Column, wanted: Any) -> Column:
    """Deep, type-strict equality with a known value; NULL where value is missing."""
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(encode(wanted))))


def number(value: Column) -> Column:
    """The value as a double if it is a number, else NULL; strings and booleans aren't coerced."""
    return F.when(F.schema_of_variant(value).rlike(_NUMBERS), F.try_variant_get(value, "$", "double"))


def string(value: Column) -> Column:
    """The value if it is a string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
