"""Assigning points to segments against the rule itself, and one key of a million rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import joins


def test_equal_to_the_rule(spark):
    rng = random.Random(4)
    segments = [(rng.choice([1, 2, 3, None]), n, 0, rng.choice([None, *range(40)])) for n in range(80)]
    points = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(45)]), f"p{k}") for k in range(200)]
    left = spark.createDataFrame(points, "k long, at int, name string").repartition(4)
    got = {r.name: (r.k, r.at, r.n) for r in joins.assign_segment(left, spark.createDataFrame(segments, "k long, n int, s int, e int"), ["k"], "at", "s", "e", "n").collect()}

    def rule(k, at):
        mine = [(n, e) for key, n, _, e in segments if key == k and k is not None and e is not None]
        return min((n for n, e in mine if at is not None and e >= at), default=max((n for n, _ in mine), default=None))

    assert got == {name: (k, at, rule(k, at)) for k, at, name in points}
    empty = spark.createDataFrame([], "k long, n int, s int, e int")
    assert {r.n for r in joins.assign_segment(left, empty, ["k"], "at", "s", "e", "n").collect()} == {None}


def test_one_key_of_a_million_segments_and_points(spark):
    h = lambda c, s: F.pmod(F.xxhash64(c, F.lit(s)), F.lit(3_000_000))
    segments = spark.range(500_000).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.lit(0).alias("s"), h("id", 1).alias("e"))
    points = spark.range(500_000).select(F.lit("k").alias("k"), h("id", 2).alias("at"))
    found = joins.assign_segment(points, segments, ["k"], "at", "s", "e", "n")
    got = found.groupBy("at").agg(F.min("n").alias("n"), F.max("n").alias("m")).toPandas()
    pairs = segments.select("n", "e").toPandas().sort_values("e")
    least = np.minimum.accumulate(pairs["n"].to_numpy()[::-1])[::-1]
    at = np.searchsorted(pairs["e"].to_numpy(), got["at"].to_numpy())
    want = np.where(at < len(least), least[np.minimum(at, len(least) - 1)], pairs["n"].max())
    assert (got["n"].to_numpy() == want).all() and (got["m"].to_numpy() == want).all()
    assert found.count() == 500_000
