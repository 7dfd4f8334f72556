"""Steps that several queries share: what they hold in a task, and what they send between tasks."""

from __future__ import annotations

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from sparkloom.functions import masking
from sparkloom.operators import retrieval
from sparkloom.plans import ORACLE_SQL, record_queries, source_queries
from sparkloom.plans.catalog import Tables
from sparkloom.sources import readers, sinks
from sparkloom.sources.workspace import settings


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bm25(spark):
    draw = random.Random(7)
    docs = [(k, " ".join(draw.choices("a b c d e f g h i j".split(), weights=range(1, 11), k=draw.randrange(40)))) for k in range(300)] + [(300, None), (301, "")]
    docs += [(k + 400, text) for k, text in docs[:50]]  # copies tie
    asked = spark.createDataFrame([(1, "a b zz"), (2, "J j c"), (3, "none"), (4, None), (5, "e f g h i j")], "q long, text string")
    return retrieval.Bm25Index(spark.createDataFrame(docs, "id long, text string").repartition(5), "id", "text"), asked


def test_bm25_scores_a_document_from_its_own_row(bm25, monkeypatch):
    index, asked = bm25
    found, best = index.search(asked, "q", "text", 7, digits=6), index.best_scores(asked, "q", "text")
    assert _plan(found).count("hashpartitioning") == 1 and "Aggregate" not in _plan(found) + _plan(best)
    every = {(r.q, r.id): r.score for r in index.scores(asked, "q", "text").collect()}
    for products in (1 << 20, 1):
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        got = {(r.q, r["rank"], r.id): r.score for r in index.search(asked, "q", "text", 7, digits=6).collect()}
        ranked = [(q, n + 1, i) for q in (1, 2, 5) for n, (i, _) in enumerate(sorted(((i, -round(s, 6)) for (a, i), s in every.items() if a == q), key=lambda x: (x[1], x[0]))[:7])]
        assert sorted(got) == ranked and all(abs(s - every[q, i]) < 1e-6 for (q, _, i), s in got.items())
        most = {r.id: r.score for r in index.best_scores(asked, "q", "text").collect()}
        assert most.keys() == {i for _, i in every} and all(abs(s - max(every[q, i] for q in (1, 2, 5) if (q, i) in every)) < 1e-9 for i, s in most.items())
    monkeypatch.setattr(retrieval, "ASKED", 0)
    assert {(r.q, r["rank"], r.id) for r in index.search(asked, "q", "text", 7, digits=6).collect()} == set(ranked)
    assert {r.id for r in index.best_scores(asked, "q", "text").collect()} == most.keys()


def test_folders_are_written_and_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FOLDERS", 5)
    rows = spark.range(60).select(F.concat(F.lit("S"), F.col("id") % 30).alias("k"), F.lit('{"score": 3}').alias("value")).coalesce(1)
    dealt = sinks.by_folder(rows, "k")
    assert 5 <= dealt.rdd.getNumPartitions() <= 7
    sinks.write_folders(dealt, f"{tmp_path}/out", "k", "text")
    assert sorted(p.parent.name for p in tmp_path.glob("out/*/*.txt")) == sorted(f"k=S{n}" for n in range(30))
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    sinks.write_folders(spark.range(200).select(F.col("id").alias("submission"), F.lit('{"score": 3}').alias("value")).coalesce(1), f"{tmp_path}/many", "submission", "text")
    done = set(tasks.getJobIdsForGroup("listing"))
    found = readers.read_submissions(spark, f"{tmp_path}/many/*", "score INT")
    listed = [tasks.getStageInfo(s).numTasks for j in set(tasks.getJobIdsForGroup("listing")) - done for s in tasks.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(listed) <= 64 and len(found.collect()) == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_logs_of_many_users_are_few_files(spark, tmp_path, monkeypatch):
    user = F.when(F.col("id") % 41 > 0, F.col("id") % 121 - 1)
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    events = spark.range(6000).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.col("id") * 7919, F.lit(600_000)))).alias("ts"), user.alias("user_id"), F.get(kinds, F.pmod(F.xxhash64("id"), F.lit(5)).cast("int")).alias("event_type"), (F.col("id") % 50).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(source_queries, "workspace", lambda spark, name: f"file://{tmp_path}/{name}")
    with settings(spark, spark__sql__files__maxPartitionBytes="20000", spark__sql__files__openCostInBytes="1"):  # a log goes on in the next split
        got = source_queries.log_intervals(Tables(spark, str(tmp_path))).collect()
    names = list(got[0].asDict())
    want = duckdb.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['log_intervals'].replace('FROM events', f"FROM '{tmp_path}/events.parquet/*.parquet'")})").fetchall()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want) and min(r.user_id for r in got) == -1
    assert len(list(tmp_path.glob("logs/**/part-*"))) <= 8


def test_logs_are_read_alike_from_a_file_each_and_many_to_a_file(spark, tmp_path):
    tick, audio = "2024-01-01 10:00:0{}.5 x Tick {} completed", "Agent audio: {} bytes"
    silent = ["line"] * 8
    logs = {
        "a": [tick.format(1, 1), *silent, audio.format(5), tick.format(2, 2), *silent, "line", audio.format(5), "2024-01-01 10:00:04.0 [USER] said speech=True", "Reward: 0.5", "Reward: 1.0", "2024-01-01 10:00:09.0 FINISHED SIMULATION"],
        "b": [tick.format(1, 1), audio.format(0), "2024-01-01 10:00:09.0 FINISHED SIMULATION"],
        "c": [tick.format(3, 9), audio.format(7), "2024-01-01 10:00:05.0 speech_started", "2024-01-01 10:00:07.0 FINISHED SIMULATION", "FINISHED SIMULATION of no time"],
    }
    for name, lines in logs.items():
        (tmp_path / "each" / name).mkdir(parents=True)
        (tmp_path / "each" / name / f"{name}.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "many.log").write_text("".join(f"[{name}] {line}\n" for name, lines in logs.items() for line in lines) + "nobody's Reward: 3\n")
    each = {tuple(r)[1:] for r in readers.log_intervals(spark, f"file://{tmp_path}/each/*", 3).collect()}
    for size in ("100", "1000000"):
        with settings(spark, spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes="1"):
            many = readers.log_intervals(spark, f"file://{tmp_path}/many.log", 3, log=r"^\[(\w+)\] ").collect()
        assert {tuple(r)[1:] for r in many} == each and {r.file: r.silence_seconds for r in many} == {"a": 7.5, "c": 3.5}


def test_order_records_gather_what_differs_only(spark, sf_dir):
    records = record_queries.order_records(Tables(spark, sf_dir))
    gathered = [line for line in records._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert gathered and not any("assistant" in line or "write" in line for line in gathered)


def test_masks_without_python(spark):
    texts = [(0, "the cat, cats; öcat cat_ cat"), (1, None), (2, ""), (3, "a+b [[9]] [[x]] a+ba+b"), (4, "cat foodcat food"), (5, "none")]
    df = spark.createDataFrame(texts, "id long, text string").select("id", "text", masking.mask("text", ["cat", "cat food", "a+b"]).alias("m")).select("*", masking.unmask("m.text", "m.terms").alias("back"))
    assert "Python" not in _plan(df)
    pattern = masking.term_pattern(["cat", "cat food", "a+b"])
    for r in df.collect():
        assert r.back == r.text and (r.m.text, r.m.terms) == (masking.mask_text(r.text, pattern) if r.text is not None else (None, None))
    with pytest.raises(Exception, match="mark 1 was lost"):
        spark.range(1).select(masking.unmask(F.lit("[[0]]"), F.array(F.lit("a"), F.lit("b")))).collect()
