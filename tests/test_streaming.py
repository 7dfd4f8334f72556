"""Streams give the rows of the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ticks, windows
from sparkloom.sources.workspace import settings
from sparkloom.streaming import stateful


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k % 3, 1000 + 10 * k + (200 if k > 20 else 0), ["o", "c", "o", "x", "c"][k % 5], ["user", "user", "assistant"][k % 3 if k % 4 else 0]) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, at long, kind string, role string").withColumn("ts", F.timestamp_seconds("at"))
    for part in range(4):
        df.where((F.col("at") >= 1000 + part * 100 + (200 if part > 1 else 0)) if part else F.lit(True)).where(F.col("at") < [1100, 1200, 1500, 9999][part]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


SCHEMA = "k long, at long, kind string, role string, ts timestamp"


def test_intervals(spark, folder, tmp_path):
    batch = spark.read.parquet(folder).distinct()
    stateful.run_once(stateful.stream_open_intervals(stateful.event_stream(spark, folder, SCHEMA), "k", "at", "kind", "o", "c"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.k, r.opened_at, r.closed_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = ticks.close_intervals(spark.read.parquet(folder), ["k"], "at", F.col("kind") == "o", F.col("kind") == "c").where("closed_at IS NOT NULL")
    assert batch.count() == spark.read.parquet(folder).count()
    stacks, expected = {}, []
    for r in sorted(batch.collect(), key=lambda r: r.at):
        if r.kind == "o":
            stacks.setdefault(r.k, []).append(r.at)
        elif r.kind == "c" and stacks.get(r.k):
            expected.append((r.k, stacks[r.k].pop(), r.at))
    assert got == sorted(expected) and want.count() > 0


def test_segments(spark, folder, tmp_path):
    stateful.run_once(stateful.stream_segments(stateful.event_stream(spark, folder, SCHEMA), ["k"], "ts", "60 seconds", "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.k, r.n, r.start) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    rows = windows.segments(spark.read.parquet(folder), ["k"], F.col("at"), 59)
    batch = {(r.k, r.n, r.start) for r in windows.segment_bounds(rows, ["k"], F.col("at")).select("k", "n", F.timestamp_seconds("start").alias("start")).collect()}
    # The last segment of a key stays open until the watermark passes it.
    assert got and got <= batch


def test_waiting_turns(spark, folder, tmp_path):
    stateful.run_once(stateful.stream_leading_turns(stateful.event_stream(spark, folder, SCHEMA), "k", "at", "role"), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(folder).collect()
    want, waiting = [], {}
    for r in sorted(rows, key=lambda r: r.at):
        waiting[r.k] = waiting.get(r.k, 0) + 1 if r.role == "user" else 0
        want.append((r.k, r.at, waiting[r.k]))
    assert sorted((r.k, r.at, r.waiting) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)



def test_upserts_keep_the_last_version(spark, tmp_path):
    for version in range(2):
        spark.createDataFrame([(1, f"v{version}"), (10 + version, "x")], "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.event_stream(spark, f"{tmp_path}/in", "k long, v string")
        stateful.upsert_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["k"]).awaitTermination()
    got = sorted(map(tuple, stateful.latest_versions(spark, f"{tmp_path}/out", ["k"]).collect()))
    assert got == [(1, "v1"), (10, "x"), (11, "x")]


def test_correlated_events(spark, folder):
    got = stateful.correlate(spark.read.parquet(folder), "k", "kind", "ts", ["o", "c", "zzz"]).collect()
    assert len(got) == 3 and all(r.zzz is None and r.o is not None for r in got)


def test_streams_joined_over_many_triggers(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(4), 1_700_000_000 + rng.randrange(20_000), rng.choice("abc")) for _ in range(250)]
    rows = sorted(set(rows), key=lambda r: r[1] + rng.randrange(80))  # out of order within the watermark's delay
    end = 1_700_900_000
    for part in (*(rows[k : k + 50] for k in range(0, len(rows), 50)), [(99, end, k) for k in "abc"], [(99, end + 1, k) for k in "abc"]):
        spark.createDataFrame(part, "item long, at long, kind string").select("item", "kind", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stateful.event_stream(spark, f"{tmp_path}/in", "item long, kind string, ts timestamp", per_trigger=1)
    with settings(spark, spark__sql__shuffle__partitions="2"):
        stateful.run_once(stateful.correlate_streams(stream, "item", "kind", "ts", ["a", "b", "c"], "300 SECONDS", "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").where("item < 99").select("item", *(F.unix_timestamp(k) for k in "abc")).collect()
    near = lambda item, at, kind: [t for i, t, k in rows if i == item and k == kind and at <= t <= at + 300] or [None]
    want = [(item, at, b, c) for item, at, kind in rows if kind == "a" for b in near(item, at, "b") for c in near(item, at, "c")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(None in x for x in want) and any(None not in x for x in want)
