"""What the vector operators share: which vectors take part, and one vector for each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no component null or not finite."""
    limit = float("inf")
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit))), F.lit(False))


def one_for_each_id(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector``: of rows that share an id, the least usable vector (so repeated rows are one)."""
    chosen = F.when(usable(F.col(vector_col)), F.col(vector_col))
    return df.select(F.col(id_col).alias("id"), chosen.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
