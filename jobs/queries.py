"""The jobs as queries: each run twice over the whole tables into one new folder, its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import language_drift, run_report
from jobs.common import beside
from sparkloom.sources.workspace import workspace


def job1_language_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language drift of ``conversations``; the second run finds nothing new."""
    path = workspace(spark, "job1")
    for _ in range(2):
        language_drift.run(spark, f"{sf_dir}/conversations.parquet", f"{path}/output", f"{path}/checkpoint", beside(language_drift.__file__, language_drift.CONFIG))
    return language_drift.current(spark, f"{path}/output").drop("batch")


def job2_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of all runs; the second makes the same partitions again."""
    path = workspace(spark, "job2")
    for _ in range(2):
        run_report.run(spark, sf_dir, path, beside(run_report.__file__, run_report.CONFIG))
    return spark.read.parquet(path)


QUERIES = {"job1_language_drift": job1_language_drift, "job2_run_report": job2_run_report}


def _drift_sql() -> str:
    markers = beside(language_drift.__file__, language_drift.CONFIG)["markers"]
    names = sorted(markers)
    count = {n: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in markers[n])})))" for n in names}
    counts = ", ".join(f"{c} AS k_{n}" for n, c in count.items())
    most = f"greatest({', '.join(f'k_{n}' for n in names)})"
    best = " ".join(f"WHEN k_{n} = {most} THEN '{n}'" for n in names)
    return f"""
WITH words AS (SELECT conv_id, turn, role, text, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS w FROM conversations),
counted AS (SELECT *, {counts} FROM words),
labelled AS (SELECT conv_id, turn, role, CASE WHEN {most} = 0 THEN NULL {best} END AS detected, role = 'assistant' AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' AS spoken FROM counted),
opened AS (SELECT conv_id, arg_min(detected, (turn, detected)) FILTER (role = 'user' AND detected IS NOT NULL) AS language FROM labelled GROUP BY conv_id),
joined AS (SELECT l.*, o.language, l.spoken AND l.detected <> o.language AS off FROM labelled l JOIN opened o ON l.conv_id IS NOT DISTINCT FROM o.conv_id),
others AS (SELECT conv_id, string_agg(detected, '|' ORDER BY n DESC, detected) AS drift_languages FROM (SELECT conv_id, detected, count(*) AS n FROM joined WHERE off GROUP BY ALL) GROUP BY conv_id)
SELECT j.conv_id, j.language, count(*) AS turns, count(*) FILTER (spoken) AS agent_turns, count(*) FILTER (spoken AND detected = language) AS correct, count(*) FILTER (off) AS drifted,
       CASE WHEN j.language IS NOT NULL THEN round_even(CAST(count(*) FILTER (spoken AND detected = language) AS DOUBLE) / nullif(count(*) FILTER (spoken), 0), 4) END AS score,
       min(turn) FILTER (off) AS first_drift_turn, coalesce(any_value(o.drift_languages), '') AS drift_languages
FROM joined j LEFT JOIN others o ON j.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY j.conv_id, j.language
"""


def _pass(k: int) -> str:
    product = " * ".join(f"(CAST(c - {i} AS DOUBLE) / (n - {i}))" for i in range(k))
    return f"avg(CASE WHEN n < {k} THEN NULL WHEN c < {k} THEN 0.0 ELSE {product} END)"


ORACLE_SQL = {
    "job1_language_drift": _drift_sql(),
    "job2_run_report": f"""
WITH lines AS (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS r, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS rc,
         count(*) FILTER (l_returnflag <> 'N') AS w, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS wc FROM lineitem GROUP BY 1),
sims AS (
  SELECT c_mktsegment AS domain, n_name AS language, o_custkey, o_orderpriority IS DISTINCT FROM '5-LOW' AS valid, o_orderstatus = 'F' AS ok, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, r, rc, w, wc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lines ON o_orderkey = l_orderkey),
tasks AS (
  SELECT domain, language, o_custkey, count(*) FILTER (valid) AS n, count(*) FILTER (valid AND ok) AS c, count(*) FILTER (NOT valid) AS void, sum(cents) FILTER (valid) AS cents,
         sum(r) FILTER (valid) AS r, sum(rc) FILTER (valid) AS rc, sum(w) FILTER (valid) AS w, sum(wc) FILTER (valid) AS wc FROM sims GROUP BY ALL),
runs AS (
  SELECT domain, language, count(*) FILTER (n > 0) AS tasks, CAST(sum(n) AS BIGINT) AS trials, CAST(sum(void) AS BIGINT) AS void_trials, {_pass(1)} AS p1, {_pass(2)} AS p2, {_pass(3)} AS p3,
         CAST(sum(cents) // nullif(sum(n), 0) AS BIGINT) AS cents, sum(r) AS r, sum(rc) AS rc, sum(w) AS w, sum(wc) AS wc FROM tasks GROUP BY ALL)
SELECT domain, language, CAST(row_number() OVER (PARTITION BY domain ORDER BY p1 DESC NULLS LAST, language) AS INTEGER) AS place, tasks, trials, void_trials,
       round(p1, 6) AS pass_hat_1, round(p2, 6) AS pass_hat_2, round(p3, 6) AS pass_hat_3, round(p1 - max(p1) FILTER (language = 'NATION_0') OVER (PARTITION BY domain), 6) AS gap_to_baseline,
       round(p3 / nullif(p1, 0), 6) AS rho, cents AS mean_cost_cents, round_even(CAST(rc AS DOUBLE) / nullif(r, 0), 6) AS read_share, round_even(CAST(wc AS DOUBLE) / nullif(w, 0), 6) AS write_share
FROM runs
""",
}
