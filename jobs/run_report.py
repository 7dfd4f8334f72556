"""Report of evaluation runs: success over repeated trials, actions, cost, rank and gap to the baseline language.

A run is a domain (a market segment) in a language (a nation's), a task a customer, a trial an order, an
action a line of it. The job reads ``customer``, ``nation``, ``orders`` and ``lineitem``, and writes a
row for each run into ``output``, a partition for each domain. Trials that the infrastructure ended count as
void: they are numbered, but no metric takes them in.

Only the partitions of the domains asked for are replaced (all, if the config names none), each when the
whole result has been computed, so a rerun over the same tables leaves the same rows, and one that broke
off is simply run again.

    python -m jobs.run_report --input DIR --output DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import beside, command_line, log, read_config
from sparkloom.functions.stats import col, rate_or_blank
from sparkloom.operators import metrics

CONFIG = "run_report.json"
#: What is read of each table.
COLUMNS = {
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_returnflag", "l_linestatus"],
}
RUN = ["domain", "language"]


def report(customer: DataFrame, nation: DataFrame, orders: DataFrame, lineitem: DataFrame, config: dict) -> DataFrame:
    """One row for each run that has trials."""
    tasks = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("domain"), F.col("n_name").alias("language"))
    if config["domains"]:
        tasks = tasks.where(col("domain").isin(*config["domains"]))
    void = F.col("o_orderpriority") == config["infrastructure_priority"]
    trials = orders.select(
        "o_orderkey", "o_custkey", F.when(void, metrics.INFRASTRUCTURE[0]).otherwise("agent_stop").alias("termination"),
        (F.col("o_orderstatus") == config["success_status"]).cast("double").alias("reward"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    # Lines are summed by trial before they are joined: both sides then have one row for each order.
    kind = F.when(F.col("l_returnflag") == config["read_flag"], "read").otherwise("write")
    actions = metrics.action_totals(lineitem, ["l_orderkey"], F.col("l_linestatus") == "F", kind)
    counts = ["read_actions", "read_correct", "write_actions", "write_correct"]
    sims = trials.join(actions.select("l_orderkey", *counts), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(tasks, F.col("o_custkey") == F.col("c_custkey"))
    valid = F.coalesce(~F.col("termination").isin(*metrics.INFRASTRUCTURE), F.lit(True))
    # One aggregation by task, one by run; void trials only add to their own count.
    by_task = sims.groupBy(*RUN, "o_custkey").agg(
        F.count_if(valid).alias("n"), F.count_if(valid & (F.col("reward") == 1.0)).alias("c"), F.count_if(~valid).alias("void"),
        F.sum(F.when(valid, F.col("cents"))).alias("cents"), *(F.sum(F.when(valid, F.col(c))).alias(c) for c in counts),
    )
    ks = range(1, config["trials"] + 1)
    by_run = by_task.groupBy(*RUN).agg(
        F.count_if(F.col("n") > 0).alias("tasks"), F.sum("n").alias("trials"), F.sum("void").alias("void_trials"),
        *(F.avg(metrics.pass_hat("n", "c", k)).alias(f"pass_hat_{k}") for k in ks), F.sum("cents").alias("cents"), *(F.sum(c).alias(c) for c in counts),
    )
    domain = Window.partitionBy("domain")
    place = F.row_number().over(domain.orderBy(F.desc_nulls_last("pass_hat_1"), "language"))
    base = F.max(F.when(F.col("language") == config["baseline_language"], F.col("pass_hat_1"))).over(domain)
    out = by_run.withColumns({"place": place, "gap_to_baseline": F.col("pass_hat_1") - base})
    rounded = [F.round(c, 6).alias(c) for c in (*(f"pass_hat_{k}" for k in ks), "gap_to_baseline")]
    return out.select(
        *RUN, "place", "tasks", "trials", "void_trials", *rounded, F.round(metrics.consistency(f"pass_hat_{ks[-1]}", "pass_hat_1"), 6).alias("rho"), F.expr("CASE WHEN trials > 0 THEN cents DIV trials END").alias("mean_cost_cents"),
        rate_or_blank("read_correct", "read_actions").alias("read_share"), rate_or_blank("write_correct", "write_actions").alias("write_share"),
    )


def run(spark: SparkSession, input_path: str, output: str, config: dict) -> int:
    """Make the report from the tables under ``input_path``; returns the number of rows written."""
    seen = {name: Observation(name) for name in COLUMNS}
    tables = {name: spark.read.parquet(f"{input_path}/{name}.parquet").select(*COLUMNS[name]).observe(seen[name], F.count(F.lit(1)).alias("rows")) for name in seen}
    written = Observation("written")
    rows = report(**tables, config=config).observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(output)
    for name, observation in seen.items():
        log.info("read %d rows of %s/%s.parquet", observation.get["rows"], input_path, name)
    log.info("wrote %d runs to %s", written.get["rows"], output)
    return written.get["rows"]


def main() -> int:
    args = command_line(__doc__, {"input": "folder of the tables", "output": "folder of the report"})
    spark = SparkSession.builder.appName("run report").getOrCreate()
    try:
        run(spark, args.input, args.output, read_config(spark, args.config) if args.config else beside(__file__, CONFIG))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
