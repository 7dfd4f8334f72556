"""Shares as text, rounded as SQL rounds them; pairs of legs, dealt out and stored."""

import duckdb
from pyspark.sql import functions as F

from sparkloom.operators import analytics, joins
from sparkloom.plans import ORACLE_SQL, QUERIES


def test_shares_on_a_tie_of_the_last_digit(spark, tmp_path):
    """Groups of 2000 rows: every other share ends in a 5 that three digits leave out."""
    n = F.pmod("id", F.lit(2000))
    rows = spark.range(2000 * 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2000)).alias("source"), F.when(n <= F.floor(F.col("id") / 2000), "a").otherwise("b").alias("lang"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["language_run_summary"](spark, f"file://{tmp_path}").collect()}
    want = duckdb.execute(ORACLE_SQL["language_run_summary"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == set(want)


def test_six_digits_are_those_of_sql(spark):
    """4012 of 64000 lies on a tie as a decimal, but its double times a million doesn't."""
    rows = spark.range(64_000).select(F.lit("s").alias("s"), F.when(F.col("id") < 4012, "a").otherwise("b").alias("k"))
    share = analytics.distribution(rows, ["s"], "k").first().shares["a"]
    assert share == duckdb.execute("SELECT round_even(4012 / 64000::DOUBLE, 6)").fetchone()[0]


def test_pairs_of_few_legs_are_made_by_several_tasks(spark):
    legs = spark.range(2000).coalesce(1).select(F.col("id").alias("n"), (F.col("id") % 20).alias("a"), (F.col("id") % 19).alias("b"), (F.col("id") % 7).alias("d"), F.col("id").alias("dep"), (F.col("id") + 9).alias("arr"))
    pairs = joins.two_legs(legs, "a", "b", "d", "dep", "arr").select("n_1", "n_2", F.spark_partition_id().alias("task")).collect()
    rows = legs.collect()
    assert sorted((r.n_1, r.n_2) for r in pairs) == sorted((x.n, y.n) for x in rows for y in rows if x.b == y.a and x.d == y.d and y.dep >= x.arr)
    assert len({r.task for r in pairs}) > 4


def test_legs_of_one_place_and_day_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "SLICE", 40, raising=False)
    monkeypatch.setattr(joins, "BLOCK", 8, raising=False)
    n = F.col("id")
    legs = spark.range(400).select(n.alias("n"), F.lit(1).alias("a"), F.when(n % 50 > 0, 1).alias("b"), F.lit(3).alias("d"), F.when(n % 45 > 0, n % 90).alias("dep"), (n % 90 + 9).alias("arr"))
    legs = legs.unionByName(legs.where("n < 30").withColumns({"n": F.col("n") + 400, "d": F.lit(4)}))
    rows = legs.collect()
    for step in (0, 1):
        pairs = joins.two_legs(legs, "a", "b", "d", "dep", "arr", F.col("d_1") + step)
        assert pairs.columns == [f"{c}_{side}" for side in (1, 2) for c in legs.columns]
        got = pairs.select("*", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.n_1, r.n_2) for r in got) == sorted((x.n, y.n) for x in rows for y in rows if x.b == y.a and x.d + step == y.d and y.dep is not None and y.dep >= x.arr)
        by_n = {r.n: r for r in rows}
        assert all(tuple(r)[:-1] == (*by_n[r.n_1], *by_n[r.n_2]) for r in got)
    assert len({r.task for r in joins.two_legs(legs, "a", "b", "d", "dep", "arr").select(F.spark_partition_id().alias("task")).collect()}) > 4


def test_pairs_of_legs_are_stored_in_few_bytes(spark, tmp_path):
    n = F.col("id")
    legs = spark.range(6000).select((F.xxhash64("id") % 1_000_000).alias("n"), F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1).alias("d"), (n * 7919 % 86_400).alias("dep"), (n * 7919 % 86_400 + 3600).alias("arr"))
    joins.two_legs(legs, "a", "b", "d", "dep", "arr").select("n_1", "n_2").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert pairs > 15_000_000 and sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < pairs / 4
