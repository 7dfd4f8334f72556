"""Runs, gaps and islands, ranks and keep-last, as window expressions.

Every window is partitioned by the caller's keys; within a key rows need a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_rows(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Position in a sorted group, from 1; equal rows get different ranks."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by ``order`` (W02); NULL keys are a key."""
    backwards = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(backwards)).where("__n = 1").drop("__n")


def keep_best(df: DataFrame, keys: list[str], quality: list[Column]) -> DataFrame:
    """One row for each key, by best quality first (A11, W03): one aggregation, no sort of the table."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*quality)).alias("__best")).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


def segments(df: DataFrame, keys: list[str], position: Column, gap: Column | int, active: Column | None = None, name: str = "segment") -> DataFrame:
    """Number the segments of rows whose positions lie at most ``gap`` apart.

    Only rows for which ``active`` holds are returned.
    """
    rows = df if active is None else df.where(active)
    rows = rows.withColumn("__p", position)
    order = Window.partitionBy(*keys).orderBy("__p")
    apart = F.col("__p") - F.lag("__p").over(order)
    begins = F.when(apart.isNull() | (apart > gap), 1).otherwise(0)
    return rows.withColumn("__b", begins).withColumn(name, F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__b", "__p")


def segment_bounds(df: DataFrame, keys: list[str], position: Column, segment: str = "segment", extra: list[Column] | None = None) -> DataFrame:
    """First and last position and row count of each segment."""
    return df.groupBy(*keys, segment).agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("n"), *(extra or []))


def true_runs(df: DataFrame, keys: list[str], order: list[Column], flag: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows for which ``flag`` holds, also one at the end (W05): ``keys, first, last, length``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__n", F.row_number().over(w)).where(flag)
    rows = rows.withColumn("__run", F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n")))
    runs = rows.groupBy(*keys, "__run").agg(F.min("__n").alias("first"), F.max("__n").alias("last"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("__run")


def leading_run(df: DataFrame, keys: list[str], order: list[Column], flag: Column, latest: int | None = None) -> DataFrame:
    """How many of the first rows (of the first ``latest``) fulfil ``flag`` before one doesn't."""
    rows = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = rows.where(F.col("__n") <= latest) if latest else rows
    broken = F.min(F.when(~F.coalesce(flag, F.lit(False)), F.col("__n")))
    return rows.groupBy(*keys).agg(F.coalesce(broken - 1, F.count(F.lit(1))).cast("long").alias("run"))


def first_flag(df: DataFrame, keys: list[str], order: list[Column], eligible: Column, name: str = "is_first") -> DataFrame:
    """Mark each key's first eligible row."""
    w = Window.partitionBy(*keys, eligible).orderBy(*order)
    return df.withColumn(name, eligible & (F.row_number().over(w) == 1))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, text: str | None = None) -> DataFrame:
    """Join intervals at most ``gap`` apart (W09), NULL ends reaching as far as the start; texts are joined in order."""
    stop = F.coalesce(end, start)
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__reach", reach).withColumn("__b", F.when(F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min(start).alias(start), F.max(stop).alias(end), F.count(F.lit(1)).alias("n")]
    if text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), stop.alias("e"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias(text))
    return rows.groupBy(*keys, "island").agg(*aggs)


def merge_contiguous(df: DataFrame, keys: list[str], position: str, kind: Column, text: str, barrier: Column | None = None, separator: str = " ") -> DataFrame:
    """Join consecutive rows of one kind; a barrier row stands alone."""
    order = Window.partitionBy(*keys).orderBy(position)
    rows = df.withColumn("__k", kind).withColumn("__x", F.coalesce(barrier, F.lit(False)) if barrier is not None else F.lit(False))
    changes = ~F.col("__k").eqNullSafe(F.lag("__k").over(order)) | F.col("__x") | F.coalesce(F.lag("__x").over(order), F.lit(False)) | F.lag(position).over(order).isNull()
    rows = rows.withColumn("__b", changes.cast("int")).withColumn("run", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), separator)
    return rows.groupBy(*keys, "run").agg(F.first("__k").alias("kind"), F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n"), joined.alias(text))


def renumber(df: DataFrame, keys: list[str], order: list[Column], name: str = "turn_idx") -> DataFrame:
    """Positions from 0 by order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def text_cursor(df: DataFrame, keys: list[str], order: list[Column], ratio: Column, text: str) -> DataFrame:
    """Deal a text out over rows by growing shares; the cursor never goes back."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(F.ceil(ratio * F.length(text))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = df.withColumn("__to", F.least(reach, F.length(text)))
    start = F.coalesce(F.lag("__to").over(w), F.lit(0))
    return rows.withColumn("piece", F.substring(F.col(text), start + 1, F.col("__to") - start)).drop("__to")
