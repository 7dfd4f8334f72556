"""A small filter language: ``field__op=value`` constraints, compiled to one Column.

A field that a table lacks reads as NULL. Comparisons of unlike types don't fail: they are false.
Values enter plans as literals, never as SQL text.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "in", "nin")
#: Arguments that a JSON query carries beside its constraints.
RESERVED = ("limit", "return_ids")


def parse_constraint(key: str) -> tuple[str, str]:
    """Field and operator of a key (F02): split at the last ``__``; an unknown operator is ``eq``.

    The field is cut at that ``__`` even if the operator is unknown.
    """
    field, mark, op = key.rpartition("__")
    if not mark:
        return key, "eq"
    return field, op if op in OPS else "eq"


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "number"
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "other"


def _alike(kind: T.DataType, value: Any) -> bool:
    """Whether a column and a value can be equal or ordered."""
    number, string = isinstance(kind, (T.NumericType, T.BooleanType)), isinstance(kind, T.StringType)
    if _kind(value) == "number":
        return number
    if _kind(value) == "string":
        return string or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return not number and not string


def _equal(a: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return a.isNull()
    if isinstance(kind, T.BooleanType) and _kind(value) == "number":
        a = a.cast("int")
        value = int(value) if isinstance(value, bool) else value
    return F.coalesce(a == F.lit(value), F.lit(False)) if _alike(kind, value) else F.lit(False)


def compare(a: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """One comparison (F03); never NULL."""
    if op == "eq":
        return _equal(a, kind, value)
    if op == "ne":
        return ~_equal(a, kind, value)
    if op in ("gt", "gte", "lt", "lte"):
        if value is None or not _alike(kind, value):
            return F.lit(False)
        b = F.lit(value)
        found = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    elif op == "contains":
        if isinstance(kind, T.ArrayType):
            found = F.array_contains(a, value) if value is not None else F.exists(a, lambda x: x.isNull())
        elif isinstance(kind, T.StringType) and isinstance(value, str):
            found = F.contains(a, F.lit(value))
        else:
            return F.lit(False)
    elif op in ("startswith", "endswith"):
        # Values are compared as Python writes them: True, False and None.
        text = F.when(a, "True").when(~a, "False") if isinstance(kind, T.BooleanType) else a.cast("string")
        found = F.startswith(text, F.lit(str(value))) if op == "startswith" else F.endswith(text, F.lit(str(value)))
    else:
        if isinstance(value, str):  # membership in a string is a substring test
            inside = F.contains(F.lit(value), a) if isinstance(kind, T.StringType) else F.lit(False)
        elif isinstance(value, (list, tuple, set)):
            inside = reduce(lambda x, y: x | y, (_equal(a, kind, v) for v in value), F.lit(False))
        else:
            return F.lit(False)
        inside = F.coalesce(inside, F.lit(False))
        found = inside if op == "in" else ~inside
    return F.coalesce(found, F.lit(False))


def compile_constraints(schema: T.StructType, constraints: Mapping[str, Any]) -> Column:
    """The conjunction of all constraints (F04); none is true."""
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = []
    for key, value in constraints.items():
        field, op = parse_constraint(key)
        known = field in kinds
        parts.append(compare(F.col(f"`{field}`") if known else F.lit(None).cast("string"), kinds.get(field, T.StringType()), op, value))
    return reduce(lambda x, y: x & y, parts, F.lit(True))


def query(df: DataFrame, constraints: Mapping[str, Any], id_col: str | None = None, return_ids: bool = False, limit: int | None = None) -> DataFrame:
    """Rows that fulfil all constraints (F01), or with ``return_ids`` their ids, each with its record.

    A limit of 0 or less still gives one row.
    """
    found = df.where(compile_constraints(df.schema, constraints))
    if limit is not None:
        found = found.orderBy(id_col).limit(max(1, limit)) if id_col else found.limit(max(1, limit))
    return found.select(id_col, F.struct("*").alias("record")) if return_ids and id_col else found


def query_json(df: DataFrame, constraints: str = "{}", id_col: str | None = None) -> DataFrame:
    """The same with constraints as JSON text (F07, L16, L17), whose ``limit`` and ``return_ids`` are arguments."""
    given = json.loads(constraints or "{}")
    if not isinstance(given, dict):
        raise ValueError("constraints must be a JSON object")
    return query(df, {k: v for k, v in given.items() if k not in RESERVED}, id_col, bool(given.get("return_ids")), given.get("limit"))


def variant_fields(df: DataFrame, record: str, fields: Mapping[str, str], keep: list[str]) -> DataFrame:
    """Typed columns from a JSON column: ``fields`` maps a path to a type; what doesn't fit is NULL."""
    parsed = F.try_parse_json(record)
    return df.select(*keep, *(F.try_variant_get(parsed, f"$.{name}", kind).alias(name.replace(".", "_")) for name, kind in fields.items()))


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables that can be queried."""
    return sorted(t.name for t in spark.catalog.listTables())


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """A whole table, None if there is none of that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else None
