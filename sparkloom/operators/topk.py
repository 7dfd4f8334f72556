"""Sorts, limits and top-k with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.stats import no_nan


def leaderboard(df: DataFrame, metric: str, ties: list[str], n: int | None = None) -> DataFrame:
    """Rows with the metric, best first, with their rank (T01). Sort and limit run as one top-k."""
    kept = df.where(no_nan(metric).isNotNull()).orderBy(F.desc(metric), *ties)
    kept = kept.limit(n) if n is not None else kept
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), *ties)))


def mean_over_present(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean of whatever columns are there (T02, V45), NULL of none."""
    present = F.filter(F.array(*(no_nan(c) for c in columns)), lambda x: x.isNotNull())
    return df.select(key, F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present).cast("double")).alias("mean"), F.size(present).alias("present"))


def top_by_score(df: DataFrame, query: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    """The k best rows of each query, ties in corpus order, scores of zero kept."""
    place = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(score), *ties))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def newest_first(df: DataFrame, columns: list[str], ties: list[str], n: int | None = None) -> DataFrame:
    """By the first date text that is there, newest first as text, missing last."""
    out = df.withColumn("date_issued", F.coalesce(*columns, F.lit(""))).orderBy(F.desc("date_issued"), *ties)
    return out.limit(n) if n is not None else out


def greedy_until(df: DataFrame, by: list[str], order: list[Column], saved: Column, total: Column, bound: Column | int) -> DataFrame:
    """The rows to cut, largest first, until what is left fits (T07): a running sum, no loop."""
    before = F.coalesce(F.sum(saved).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(total - F.col("__before") > bound).drop("__before")


def name_map(df: DataFrame, name: str, id_col: str, order: str) -> DataFrame:
    """One id for each name, the last by order, sorted by name."""
    return df.groupBy(name).agg(F.max_by(id_col, order).alias(id_col)).orderBy(name)
