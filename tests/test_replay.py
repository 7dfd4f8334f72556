"""State replay: composed changes against replaying call by call."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import scoring


def one_by_one(calls):
    """The mutations as a tool would run them, a call at a time."""
    state, failed = {}, 0
    for op, key, value in calls:
        try:
            if key is None:
                raise KeyError(key)
            if op == "set":
                state[key] = value
            elif op == "delete":
                state.pop(key, None)
            elif op == "add":
                state[key] = float(state.get(key, 0)) + float(value)
            elif op == "append":
                if not isinstance(state.get(key, []), list):
                    raise TypeError(key)
                state[key] = [*state.get(key, []), value]
            else:
                raise ValueError(op)
        except (ValueError, TypeError, KeyError):
            failed += 1
    return json.dumps(state, sort_keys=True), failed


OPS = ["set", "add", "add", "delete", "append", "append", "unknown", None]
VALUES = ["1", "2.5", "-3", "text", "", None, "7"]


def made(rng, n):
    return [(rng.choice(OPS), rng.choice(["a", "b", "é", None]), rng.choice(VALUES)) for _ in range(n)]


def test_changes_compose_however_they_are_cut():
    rng = random.Random(1)
    for _ in range(4000):
        calls = [(op, "k", value) for op, _, value in made(rng, rng.randrange(12))]
        whole, cut = None, 0
        while cut < len(calls) or whole is None:
            end = min(len(calls), cut + rng.randrange(4))
            part = scoring.KeyChange()
            for op, _, value in calls[cut:end]:
                part.call(op, value)
            part = scoring.KeyChange.unpacked(part.packed())
            whole, cut = part if whole is None else whole.then(part), end
            if not calls:
                break
        value, failed = whole.after(scoring.ABSENT)
        assert (json.dumps({} if value is scoring.ABSENT else {"k": value}), failed) == one_by_one(calls)


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_replaying(spark, seed):
    rng = random.Random(seed)
    rows = [(sim, n, *call) for sim in [None, *range(40)] for n, call in enumerate(made(rng, rng.choice([0, 1, 5, 60])))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "sim long, n long, op string, key string, value string")
    got = {r.sim: (r.state, r.failed_calls) for r in scoring.replay_states(df, "sim", "n", "op", "key", "value").collect()}
    assert got == {sim: one_by_one([x[2:] for x in rows if x[0] == sim]) for sim in {r[0] for r in rows}}
    own = {r.sim: r.state for r in scoring.replay_states(df.where("op IN ('set', 'delete') AND key IS NOT NULL"), "sim", "n", "op", "key", "value", lambda s, op, k, v: s.update({k: v}) if op == "set" else s.pop(k)).collect()}
    assert all(one_by_one([x[2:] for x in rows if x[0] == sim and x[2] in ("set", "delete") and x[3] is not None])[0] == state for sim, state in own.items())


def test_one_conversation_of_a_million_calls_is_spread(spark):
    h = F.xxhash64("id")
    op = F.element_at(F.array(*map(F.lit, ("set", "add", "append", "delete", "add", "add"))), (F.pmod(h, F.lit(6)) + 1).cast("int"))
    calls = spark.range(1_000_000).select(F.lit("s").alias("sim"), F.col("id").alias("n"), op.alias("op"), F.concat(F.lit("k"), F.pmod(F.shiftright(h, 8), F.lit(50))).alias("key"), F.pmod(F.shiftright(h, 20), F.lit(9)).cast("string").alias("value"))
    calls = calls.unionByName(calls.where("n < 10").withColumn("sim", F.lit("t")))
    plan = scoring.replay_states(calls, "sim", "n", "op", "key", "value")
    began = time.perf_counter()
    got = {r.sim: (r.state, r.failed_calls) for r in plan.collect()}
    print(f"{time.perf_counter() - began:.1f} s")
    rows = [tuple(r) for r in calls.where("sim = 's'").orderBy("n").select("op", "key", "value").toLocalIterator()]
    assert got["s"] == one_by_one(rows) and got["t"] == one_by_one(rows[:10])
    dealt = calls.select("sim", F.col("n").alias("at")).repartitionByRange("sim", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 300_000


def test_simulations_within_a_task_are_done_there(spark):
    # Of 2,000 simulations only a task's first and last hand on changes; the others are written as states.
    h = F.xxhash64("id")
    calls = spark.range(10_000).select((F.col("id") % 2000).cast("double").alias("sim"), F.col("id").alias("n"), F.element_at(F.array(F.lit("set"), F.lit("add"), F.lit("append")), (F.pmod(h, F.lit(3)) + 1).cast("int")).alias("op"), F.lit("k").alias("key"), F.pmod(h, F.lit(9)).cast("string").alias("value"))
    calls = calls.withColumn("sim", F.when(F.col("sim") == 7, F.lit(float("nan"))).otherwise(F.col("sim")))
    states = scoring.replay_states(calls, "sim", "n", "op", "key", "value")
    path = next(f for f in states.inputFiles()).rsplit("/", 1)[0]
    assert 0 < spark.read.parquet(path).where("part IS NOT NULL").select("sim").distinct().count() <= 2 * 8
    got = {str(r.sim): (r.state, r.failed_calls, r.state_hash) for r in states.collect()}
    rows = calls.orderBy("n").collect()
    assert len(got) == 2000 == states.count()
    for sim in ("nan", "0.0", "1.0", "999.0", "1999.0"):
        state, failed = one_by_one([tuple(r)[2:] for r in rows if str(r.sim) == sim])
        assert got[sim] == (state, failed, scoring.state_hash(json.loads(state)))
