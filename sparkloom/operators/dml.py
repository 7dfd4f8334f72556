"""Changes to record tables. Tables are immutable: each change returns the table after it."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.predicates import compile_constraints


def insert_if_absent(df: DataFrame, rows: DataFrame, id_col: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose id it lacks, and those rows.

    Of equal new ids the first by ``order`` stays, else (and among equals) the least as a row.
    """
    rest = [c for c in rows.columns if c != id_col]
    first = F.struct(*([F.col(order).alias("__order")] if order else []), *(F.col(c) for c in rest))
    absent = rows.join(df.select(id_col), id_col, "left_anti")
    fresh = absent.groupBy(id_col).agg(F.min(first).alias("__r")).select(*(F.col(c) if c == id_col else F.col("__r")[c].alias(c) for c in rows.columns)) if rest else absent.distinct()
    return df.unionByName(fresh, allowMissingColumns=True), fresh


def update_by_id(df: DataFrame, id_col: str, record_id: Any, changes: Mapping[str, Column | Any]) -> DataFrame:
    """The table with some fields of one record set (D02); an unknown id changes nothing."""
    hit = F.col(id_col).eqNullSafe(F.lit(record_id))
    kinds = dict(df.dtypes)
    return df.withColumns({name: F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name) if name in kinds else F.lit(None)) for name, value in changes.items()})


def update_from(df: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Many updates at once: non-NULL fields of ``changes`` win."""
    names = [c for c in changes.columns if c != id_col]
    given = changes.select(id_col, *(F.col(c).alias(f"__{c}") for c in names))
    joined = df.join(given, id_col, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def merged(old: Column, new: Column, kind: T.DataType) -> Column:
    """``new`` laid over ``old`` (D05, D06): records and maps field by field at any depth, all else replaced where it isn't NULL."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*(merged(old[f.name], new[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(fields)
    if isinstance(kind, T.MapType):
        both = F.map_zip_with(old, new, lambda _, a, b: merged(a, b, kind.valueType))
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both)
    return F.coalesce(new, old)


def merge_records(df: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Records with those of ``changes`` of the same id merged in (D05); columns that only one side has stay or are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in changes.columns if c != id_col and c in kinds]
    given = changes.select(id_col, *(F.col(c).cast(kinds[c]).alias(f"__{c}") for c in names))
    return df.join(given, id_col, "left").select(*(merged(F.col(c), F.col(f"__{c}"), kinds[c]).alias(c) if c in names else F.col(c) for c in df.columns))


def merge_maps(old: Column, new: Column) -> Column:
    """Map merge, the new value winning, one level; see :func:`merged` for any depth."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def delete_where(df: DataFrame, constraints: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and the rows that go."""
    gone = compile_constraints(df.schema, constraints)
    return df.where(~gone), df.where(gone)
