"""Turn taking: the policy rule by rule, and the stream against the policy run over each key's rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.workspace import settings
from sparkloom.streaming import stateful, turns
from sparkloom.streaming.turns import Policy, Standing, replay

FAST = Policy(wait_other=50, wait_self=80, interrupted=2, interrupting=4, interrupt_after=6, backchannel_after=3, backchannel_every=4, interval=1, overlap=30, idle=1000)


def actions(policy, *events, until=None):
    return [(at, action) for at, _, action in replay(Standing(), policy, [(at, k, kind) for k, (at, kind) in enumerate(events)], until)[1]]


def test_stops_when_talked_over():
    told = actions(FAST, (0, "self"), (10, "self"), (20, "other"), (21, "self"), (30, "other"), (31, "self"))
    assert [a for _, a in told] == ["keep_talking", "keep_talking", "wait", "keep_talking", "wait", "stop_talking"]


def test_holds_its_ground_longer_when_it_barged_in_or_tells_a_result():
    own = actions(FAST, (0, "other"), (5, "self"), (10, "other"), (11, "self"), (20, "other"), (21, "self"), (30, "other"), (31, "self"))
    assert [a for at, a in own if at in (11, 21, 31)] == ["keep_talking", "keep_talking", "stop_talking"]
    told = actions(FAST, (0, "tool"), (1, "self"), (5, "other"), (6, "self"), (10, "other"), (11, "self"))
    assert [a for _, a in told] == ["generate_message", "keep_talking", "wait", "keep_talking", "wait", "keep_talking"]
    assert "stop_talking" not in [a for _, a in actions(Policy(**(FAST.__dict__ | {"interrupted": None})), (0, "self"), *((k, w) for k in range(1, 20) for w in ("other", "self")))]


def test_backchannels_and_interrupts():
    listened = actions(FAST, *((10 * k, "other") for k in range(7)))
    assert [a for _, a in listened] == ["wait", "wait", "wait", "backchannel", "wait", "generate_message", "generate_message"]
    assert actions(FAST, (0, "self"), (10, "other"), (11, "other"), (12, "backchannel"))[-1] == (12, "keep_talking")
    every = Policy(**(FAST.__dict__ | {"interval": 4}))
    assert [a for _, a in actions(every, *((10 * k, "other") for k in range(9)))].count("generate_message") == 1


def test_speaks_up_once_both_were_silent():
    assert actions(FAST, (0, "other"), (10, "self"), (91, "other")) == [(0, "wait"), (10, "keep_talking"), (91, "wait")]
    assert actions(FAST, (0, "other"), (10, "self"), (92, "other")) == [(0, "wait"), (10, "keep_talking"), (91, "generate_message"), (92, "wait")]
    assert actions(FAST, (0, "other"), (900, "tool"), until=2000) == [(0, "wait"), (51, "generate_message"), (900, "generate_message")]
    assert actions(FAST, (0, "other"), until=51) == [(0, "wait")] and len(actions(FAST, (0, "other"), until=52)) == 2


def test_a_key_begins_anew_after_idling():
    state, _ = replay(Standing(), FAST, [(0, 1, "tool"), (2000, 2, "self")])
    assert state.events == 1 and not state.telling_result
    with pytest.raises(ValueError):
        Policy(idle=10)


def made(rng, keys, n):
    rows = []
    for k in range(keys):
        at = 1_700_000_000_000 + rng.randrange(100)
        for _ in range(n):
            at += rng.choice([0, 1, 5, 20, 40, 90, 300, 1500])
            rows.append((k, at, len(rows), rng.choice(["self", "other", "other", "backchannel", "tool"])))
    return rows


def expected(rows, late):
    until = max(r[1] for r in rows) - late
    out = []
    for k in {r[0] for r in rows}:
        mine = sorted((at, i, kind) for key, at, i, kind in rows if key == k and at < until)
        out += [(k, *x) for x in replay(Standing(), FAST, mine, until)[1]]
    return sorted(out, key=str)


def streamed(spark, tmp_path, name, files, per_trigger, late):
    for part in files:
        frame = spark.createDataFrame(part, "k long, at long, i long, kind string").select("k", F.timestamp_millis("at").alias("ts"), "i", "kind")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    stream = stateful.event_stream(spark, f"{tmp_path}/{name}/in", "k long, ts timestamp, i long, kind string", per_trigger=per_trigger)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=turns.STATE_STORE, spark__sql__shuffle__partitions="2"):
        stateful.run_once(turns.stream_turn_taking(stream, FAST, "k", "ts", "i", "kind", f"{late} milliseconds"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/cp")
    return sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/out").select("k", "at", "id", "action").collect()), key=str)


def test_one_trigger_and_many(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(made(rng, 5, 60), key=lambda r: r[1])
    assert streamed(spark, tmp_path, "one", [rng.sample(rows, len(rows)) + [(1, None, 1, "self"), (1, rows[0][1], 9999, "unknown")]], None, 500) == expected(rows, 500)
    # Twelve triggers, rows out of order by less than the watermark's delay.
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(400))
    size = -(-len(late) // 12)
    assert streamed(spark, tmp_path, "many", [late[k : k + size] for k in range(0, len(late), size)], 1, 500) == expected(rows, 500)


def test_a_key_of_50_000_rows_and_state_of_idle_keys(spark, tmp_path):
    rows = [(0, 1_700_000_000_000 + 7 * k, k, ("self", "other", "other")[k % 3]) for k in range(50_000)] + [(9, 1_700_000_000_000, 50_000, "tool")]
    assert streamed(spark, tmp_path, "big", [rows[::2], rows[1::2]], None, 100) == expected(rows, 100)
    state = spark.read.format("statestore").option("stateVarName", "standing").load(f"{tmp_path}/big/cp")
    assert {r.key.k for r in state.select("key").collect()} == {0}


def test_rows_wait_in_stretches_and_ids_are_exact(spark, tmp_path):
    # 25,000 rows wait for the watermark in a few elements; ids beyond 2^53 and NULL ones come in one key.
    rows = [(0, 1_700_000_000_000 + 7 * k, 2**60 + k, ("self", "other", "other")[k % 3]) for k in range(25_000)] + [(1, 1_700_000_000_000, 2**60 + 1, "self"), (1, 1_700_000_000_000, None, "other"), (1, 1_700_000_000_001, 2**60 + 3, "tool")]
    assert streamed(spark, tmp_path, "held", [rows], None, 300_000) == []
    got = streamed(spark, tmp_path, "told", [rows], None, 100)
    assert [r for r in got if r[0] == 1] == sorted([(1, 1_700_000_000_000, 2**60 + 1, "keep_talking"), (1, 1_700_000_000_000, None, "wait"), (1, 1_700_000_000_001, 2**60 + 3, "generate_message"), (1, 1_700_000_000_081, None, "generate_message")], key=str)
    assert [r for r in got if r[0] == 0] == expected(rows[:25_000], 100)
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(f"{tmp_path}/held/cp")
    assert waiting.where("key.k = 0").count() <= 5
