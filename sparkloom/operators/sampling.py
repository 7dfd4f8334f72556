"""Samples and assignments that come out alike on every run: hashes take the place of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(columns: list[str], seed: int) -> Column:
    """A number in [0, 1) from a row's key: 52 bits of the MD5 of its values and the seed, as any SQL engine can draw it."""
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def stratified_sample(df: DataFrame, strata: list[str], n: int, order: list[Column]) -> DataFrame:
    """At most n rows of each stratum, the first by ``order``, a hash as a rule."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def weighted_choice(df: DataFrame, key: list[str], weights: dict[str, float], seed: int, name: str = "choice") -> DataFrame:
    """One of the names for each row, with chances by weight."""
    total = float(sum(weights.values()))
    at, out, running = unit_hash(key, seed), None, 0.0
    for label, weight in weights.items():
        running += weight / total
        out = F.when(at < running, label) if out is None else out.when(at < running, label)
    return df.withColumn(name, out.otherwise(list(weights)[-1]))


def quota_blocks(df: DataFrame, key: list[str], shares: dict[str, float], seed: int, name: str = "choice", bins: int = 4096) -> DataFrame:
    """Shuffle by hash, then give consecutive blocks to names by share (G04, G05): shares are met exactly.

    Places in the order come from counts of ``bins`` ranges of the hash, which are few, and row numbers
    within a range; so no task sees all rows.
    """
    rows = df.withColumn("__h", unit_hash(key, seed)).withColumn("__bin", F.floor(F.col("__h") * bins))
    counts = rows.groupBy("__bin").agg(F.count(F.lit(1)).alias("__c"))
    # At most ``bins`` rows.
    every = Window.partitionBy(F.lit(0))
    before = counts.select("__bin", (F.sum("__c").over(every.orderBy("__bin")) - F.col("__c")).alias("__before"), F.sum("__c").over(every).alias("__all"))
    place = F.row_number().over(Window.partitionBy("__bin").orderBy("__h", *key)) - 1
    rows = rows.withColumn("__n", place).join(F.broadcast(before), "__bin").withColumn("__at", (F.col("__before") + F.col("__n")) / F.col("__all"))
    total, running, out = float(sum(shares.values())), 0.0, None
    for label, share in shares.items():
        running += share / total
        out = F.when(F.col("__at") < running, label) if out is None else out.when(F.col("__at") < running, label)
    return rows.withColumn(name, out.otherwise(list(shares)[-1])).select(*df.columns, name)


def every_nth_batch(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """Number batches of a fixed size within a group (P20)."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def first_ids(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """The rows of the given ids; an id that is missing raises."""
    found = {r[0] for r in df.where(F.col(id_col).isin(ids)).select(id_col).distinct().collect()}
    missing = [i for i in ids if i not in found]
    if missing:
        raise ValueError(f"no such ids: {missing[:10]}")
    return df.where(F.col(id_col).isin(ids))
