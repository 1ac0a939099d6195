"""The filter language over metadata, compiled to one boolean column.

A filter is a dict: {"field": value}, {"field": {"$op": value, ...}},
{"$and": [...]}, {"$or": [...]}; several keys are joined by and.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFilter
from ..functions import values

_ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_LISTS = ("$in", "$nin")
_ALL = ("$eq", "$ne", *_ORDER, *_LISTS)


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str
    parts: tuple


def parse(spec: Any) -> Test | Group:
    """The filter as a tree; whatever is wrong with it is raised here, before any job runs."""
    if not isinstance(spec, Mapping):
        raise InvalidFilter("filter must be an object")
    parts: list[Test | Group] = []
    for key, body in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(body, list):
                raise InvalidFilter(f"{key} requires an array")
            parts.append(Group(key, tuple(map(parse, body))))
        elif isinstance(body, Mapping):
            for op, value in body.items():
                if op not in _ALL:
                    raise InvalidFilter(f"unknown operator: {op}")
                if op in _LISTS and not isinstance(value, list):
                    raise InvalidFilter(f"{op} requires an array")
                values.encode(value)
                parts.append(Test(key, op, value))
        else:
            values.encode(body)
            parts.append(Test(key, "$eq", body))
    return parts[0] if len(parts) == 1 else Group("$and", tuple(parts))


class VariantFields:
    """Fields of a VARIANT column."""

    def __init__(self, metadata: Column):
        self.metadata = metadata

    def equal(self, name: str, value: Any) -> Column:
        return F.coalesce(values.same(values.field(self.metadata, name), value), F.lit(False))

    def order(self, name: str, compare: Callable, value: Any) -> Column:
        found = values.field(self.metadata, name)
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            return F.lit(False)
        if isinstance(value, str):
            return F.coalesce(compare(values.string(found), F.lit(value)), F.lit(False))
        return F.coalesce(compare(values.number(found), F.lit(float(value))), F.lit(False))


class TypedFields:
    """Ordinary columns as fields, NULL being a missing key; such tests reach the scan as pushed filters."""

    _KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "string": "str", "boolean": "bool"}

    def __init__(self, df: DataFrame, mapping: Mapping[str, str] | None = None):
        types = dict(df.dtypes)
        mapping = {c: c for c in types} if mapping is None else mapping
        self.fields = {f: (df[c], self._KINDS.get("float" if types[c].startswith("decimal") else types[c])) for f, c in mapping.items()}

    def equal(self, name: str, value: Any) -> Column:
        column, kind = self.fields.get(name, (None, None))
        own = "bool" if isinstance(value, bool) else type(value).__name__
        if kind is None or own != kind:
            return F.lit(False)
        return column.isNotNull() & (column == F.lit(value))

    def order(self, name: str, compare: Callable, value: Any) -> Column:
        column, kind = self.fields.get(name, (None, None))
        own = "bool" if isinstance(value, bool) else type(value).__name__
        fits = kind == own == "str" or (kind in ("int", "float") and own in ("int", "float"))
        return column.isNotNull() & compare(column, F.lit(value)) if fits else F.lit(False)


def compile(spec: Any, fields: VariantFields | TypedFields) -> Column:
    """A boolean column, never NULL, for a filter (a dict or a parsed tree)."""
    node = spec if isinstance(spec, (Test, Group)) else parse(spec)
    if isinstance(node, Group):
        parts = [compile(p, fields) for p in node.parts]
        return reduce(operator.and_, parts, F.lit(True)) if node.op == "$and" else reduce(operator.or_, parts, F.lit(False))
    if node.op == "$eq":
        return fields.equal(node.field, node.value)
    if node.op == "$ne":
        return ~fields.equal(node.field, node.value)
    if node.op in _ORDER:
        return fields.order(node.field, _ORDER[node.op], node.value)
    found = reduce(operator.or_, (fields.equal(node.field, v) for v in node.value), F.lit(False))
    return found if node.op == "$in" else ~found


def where(df: DataFrame, spec: Any, metadata: str = "metadata") -> DataFrame:
    """Rows whose VARIANT column `metadata` passes the filter."""
    return df.where(compile(spec, VariantFields(F.col(metadata))))
