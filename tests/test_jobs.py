"""The jobs: runs over growing input, replayed batches, replaced partitions, command lines."""

import glob
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import language_drift, run_report
from jobs.common import beside
from sparkloom.functions.text import marked_language
from sparkloom.sources.workspace import settings

DRIFT, REPORT = beside(language_drift.__file__, language_drift.CONFIG), beside(run_report.__file__, run_report.CONFIG)


def ordered(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def files(path):
    return {p: os.path.getsize(p) for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def whole(df, config=DRIFT):
    return ordered(language_drift.conversations(df, config["markers"]))


def test_drift_takes_only_what_is_new(spark, tmp_path, turns):
    source, output, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    run = lambda: language_drift.run(spark, source, output, checkpoint, DRIFT)
    now = lambda: ordered(language_drift.current(spark, output).drop("batch"))
    first, second = turns.where("turn < 2 AND conv_id % 3 <> 0"), turns.where("turn >= 2 OR conv_id % 3 = 0")
    add(first, source)
    assert run() == first.count() and now() == whole(first)
    before = files(tmp_path / "out")
    add(second, source)
    assert run() == second.count()
    assert now() == whole(turns)
    after = files(tmp_path / "out")
    assert before.items() <= after.items()  # what the first run wrote stays
    new = spark.read.parquet(output).where("batch = 1").select("conv_id")
    assert {r[0] for r in new.collect()} == {r[0] for r in second.select("conv_id").distinct().collect()}
    assert run() == 0 and files(tmp_path / "out") == after
    # A run that broke off before its batch was marked as done: the next makes the batch again.
    for mark in ("1", ".1.crc"):
        os.remove(tmp_path / "cp" / "commits" / mark)
    run()
    assert now() == whole(turns) and spark.read.parquet(output).select("batch").distinct().count() == 2


def test_drift_of_odd_rows(spark, tmp_path):
    rows = [
        (1, 0, "user", "Der Hund und die Katze"), (1, 1, "assistant", "the cat and the dog"), (1, 2, "assistant", "die Katze"), (1, 3, "assistant", "???"), (1, 4, "assistant", " \n"), (1, 5, "assistant", None),
        (2, 0, "system", "le chat"), (2, 1, "assistant", "the cat"), (3, 0, "user", "12345"), (3, 1, "user", "el gato"), (3, 2, "assistant", "los gatos del " * 50_000), (None, 0, "user", "the"), (4, None, None, None), (5, 7, "user", "le the"), (5, 1, "user", "the"), (5, 2, "assistant", "les"), (5, 2, "assistant", "les"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"batch": F.lit("x"), "language": F.lit(3)})
    found = {r.conv_id: r for r in language_drift.conversations(df.select("conv_id", "turn", "role", "text"), DRIFT["markers"]).collect()}
    assert found[1].asDict() == {"conv_id": 1, "language": "de", "turns": 6, "agent_turns": 3, "correct": 1, "drifted": 1, "score": 0.3333, "first_drift_turn": 1, "drift_languages": "en"}
    assert (found[2].language, found[2].drifted, found[2].score) == (None, 0, None)
    assert (found[3].language, found[3].score) == ("es", 1.0)
    assert found[None].language == "en" and found[4].turns == 1
    assert (found[5].language, found[5].drifted, found[5].drift_languages) == ("en", 2, "fr")
    source = f"file://{tmp_path}/in"
    for k in range(3):
        add(df.where(F.coalesce("turn", F.lit(0)) % 3 == k), source)
    assert language_drift.run(spark, source, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", DRIFT | {"max_files_per_trigger": 1}) == len(rows)
    assert ordered(language_drift.current(spark, f"file://{tmp_path}/out").drop("batch")) == whole(df.select("conv_id", "turn", "role", "text"))


def test_drift_of_nothing(spark, tmp_path):
    add(spark.createDataFrame([], language_drift.TURNS), f"file://{tmp_path}/in")
    assert language_drift.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", DRIFT) == 0
    assert language_drift.current(spark, f"file://{tmp_path}/out").count() == 0


def test_marked_language(spark):
    markers = {"b": ["x", "y"], "a": ["x", "z"]}
    df = spark.createDataFrame([("x",), ("Y x",), ("z-Y_y",), ("none",), (None,), ("",), ("éx",)], "t string")
    assert [r[0] for r in df.select(marked_language("t", markers)).collect()] == ["a", "b", "b", None, None, None, None]


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__shuffle__partitions="3", spark__own__name="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.own.name", None) is None


def test_report_replaces_only_what_is_asked(spark, sf_dir, tmp_path):
    source, output = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for name in run_report.COLUMNS:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"file://{source}/{name}.parquet")
    n = run_report.run(spark, f"file://{source}", output, REPORT)
    first = ordered(spark.read.parquet(output))
    assert len(first) == n
    assert run_report.run(spark, f"file://{source}", output, REPORT) == n and ordered(spark.read.parquet(output)) == first
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderstatus", F.lit("F"))
    orders.write.mode("overwrite").parquet(f"file://{source}/orders.parquet")
    run_report.run(spark, f"file://{source}", output, REPORT | {"domains": ["BUILDING"]})
    changed = spark.read.parquet(output)
    assert changed.where("domain = 'BUILDING' AND pass_hat_1 < 1").count() == 0
    assert ordered(changed.where("domain <> 'BUILDING'")) == ordered(spark.createDataFrame(first, spark.read.parquet(output).select(*sorted(changed.columns)).schema).where("domain <> 'BUILDING'"))


def test_report_of_odd_rows(spark):
    customer = spark.createDataFrame([(1, 0, "A"), (2, 1, "A"), (3, 0, None), (4, 9, "A")], "c_custkey long, c_nationkey int, c_mktsegment string")
    nation = spark.createDataFrame([(0, "NATION_0"), (1, None)], "n_nationkey int, n_name string")
    orders = spark.createDataFrame([(1, 1, "F", "1-URGENT", 10.0), (2, 1, "O", "5-LOW", 10.0), (3, 2, None, None, None), (4, 3, "F", "5-LOW", 1.0), (5, 1, "F", None, 30.0), (6, None, "F", None, 1.0), (7, 4, "F", None, 1.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    lineitem = spark.createDataFrame([(1, "N", "F"), (1, "A", "O"), (1, None, None), (2, "N", "O"), (None, "N", "F")], "l_orderkey long, l_returnflag string, l_linestatus string")
    found = {(r.domain, r.language): r for r in run_report.report(customer, nation, orders, lineitem, REPORT).collect()}
    assert set(found) == {("A", "NATION_0"), ("A", None), (None, "NATION_0")}
    best = found["A", "NATION_0"]
    assert (best.place, best.tasks, best.trials, best.void_trials, best.pass_hat_1, best.pass_hat_2, best.pass_hat_3, best.mean_cost_cents, best.read_share, best.write_share, best.gap_to_baseline) == (1, 1, 2, 1, 1.0, 1.0, None, 2000, 1.0, 0.0, 0.0)
    assert (found["A", None].pass_hat_1, found["A", None].gap_to_baseline) == (0.0, -1.0)
    assert (found[None, "NATION_0"].tasks, found[None, "NATION_0"].trials, found[None, "NATION_0"].pass_hat_1) == (0, 0, None)


@pytest.mark.parametrize("job", ["language_drift", "run_report"])
def test_command_line(sf_dir, tmp_path, job):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "own.json").write_text(json.dumps(DRIFT if job == "language_drift" else REPORT))
    paths = {"input": f"{sf_dir}/conversations.parquet", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"} if job == "language_drift" else {"input": sf_dir, "output": f"{tmp_path}/out"}
    args = [x for name, value in paths.items() for x in (f"--{name}", value)]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", str(tmp_path / "own.json")], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert "read " in done.stderr and files(tmp_path / "out")
