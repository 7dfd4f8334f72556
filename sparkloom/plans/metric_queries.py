"""Run metrics over the star schema: a task is a customer, a trial an order, an action a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import stats
from sparkloom.operators import metrics
from sparkloom.plans.catalog import Tables, query


def _success() -> Column:
    return F.col("o_orderstatus") == "F"


_TRIALS = "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY o_custkey"


def _pass(k: int, n: str = "n", c: str = "c") -> str:
    product = " * ".join(f"(CAST({c} - {i} AS DOUBLE) / ({n} - {i}))" for i in range(k))
    return f"CASE WHEN {n} < {k} THEN NULL WHEN {c} < {k} THEN 0.0 ELSE {product} END"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("pass_hat_k", f"SELECT round(avg({_pass(1)}), 6) AS pass_hat_1, round(avg({_pass(2)}), 6) AS pass_hat_2, round(avg({_pass(3)}), 6) AS pass_hat_3, round(avg({_pass(4)}), 6) AS pass_hat_4 FROM ({_TRIALS})")
def pass_hat_k(t: Tables) -> DataFrame:
    out = metrics.mean_pass_hat(metrics.trials_by_task(t.orders, "o_custkey", _success()), range(1, 5))
    return _rounded(out, *out.columns)


@query("pass_hat_by_task", f"SELECT o_custkey, n, c, round({_pass(1)}, 6) AS pass_hat_1, round({_pass(2)}, 6) AS pass_hat_2, round({_pass(3)}, 6) AS pass_hat_3 FROM ({_TRIALS})")
def pass_hat_by_task(t: Tables) -> DataFrame:
    out = metrics.pass_hat_by_task(metrics.trials_by_task(t.orders, "o_custkey", _success()), range(1, 4))
    return _rounded(out, "pass_hat_1", "pass_hat_2", "pass_hat_3")


@query("largest_k", f"SELECT least(min(n), 5) AS max_k FROM ({_TRIALS})")
def largest_k(t: Tables) -> DataFrame:
    return metrics.largest_k(metrics.trials_by_task(t.orders, "o_custkey", _success()), F.lit(5).cast("long"))


@query(
    "rho_by_segment",
    f"""WITH trials AS (SELECT c_mktsegment, o_custkey, count(o_totalprice) AS n, count(*) FILTER (o_orderstatus = 'F') AS c, avg(o_totalprice) AS price
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
     runs AS (SELECT c_mktsegment, avg({_pass(1)}) AS p1, avg({_pass(2)}) AS p2, avg({_pass(3)}) AS p3, avg(price) AS price FROM trials GROUP BY 1)
     SELECT c_mktsegment, round(p1, 6) AS pass_hat_1, round(p2, 6) AS pass_hat_2, round(p3, 6) AS pass_hat_3, round(price, 2) AS price, round(p3 / nullif(p1, 0), 6) AS rho
     FROM runs WHERE p1 IS NOT NULL AND p3 IS NOT NULL""",
)
def rho_by_segment(t: Tables) -> DataFrame:
    sims = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("reward", _success().cast("double"))
    out = metrics.run_summary(sims, ["c_mktsegment"], "o_custkey", "reward", extra=[F.avg("o_totalprice").alias("price")])
    return _rounded(_rounded(out, "pass_hat_1", "pass_hat_2", "pass_hat_3", "rho"), "price", digits=2)


@query(
    "partial_action_reward",
    """SELECT l_orderkey, count(*) AS total_actions, count(*) FILTER (l_linestatus = 'F') AS total_correct, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS total_share,
       count(*) FILTER (l_returnflag = 'N') AS read_actions, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS read_correct,
       round(count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') / nullif(count(*) FILTER (l_returnflag = 'N'), 0), 6) AS read_share,
       count(*) FILTER (l_returnflag <> 'N') AS write_actions, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS write_correct,
       round(count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0), 6) AS write_share
       FROM lineitem GROUP BY l_orderkey""",
)
def partial_action_reward(t: Tables) -> DataFrame:
    out = metrics.action_totals(t.lineitem, ["l_orderkey"], F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "N", "read").otherwise("write"))
    return _rounded(out, "total_share", "read_share", "write_share")


@query(
    "failure_patterns",
    """WITH totals AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_returnflag = 'N') AS r, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS rc,
         count(*) FILTER (l_returnflag <> 'N') AS w, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS wc FROM lineitem GROUP BY 1),
       named AS (SELECT CASE WHEN t = 0 THEN 'no_actions' WHEN r = rc AND w = wc THEN 'all_correct' WHEN w = 0 THEN 'read_failure'
         WHEN wc = 0 AND w <= 1 THEN CASE WHEN r = rc THEN 'no_write_attempted' ELSE 'read_failure_no_write' END
         WHEN w <> wc AND r = rc THEN 'write_failure' ELSE 'read_and_write_failure' END AS pattern FROM totals)
       SELECT pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM named GROUP BY pattern""",
)
def failure_patterns(t: Tables) -> DataFrame:
    totals = metrics.action_totals(t.lineitem, ["l_orderkey"], F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "N", "read").otherwise("write"))
    named = metrics.failure_pattern(totals, F.col("write_actions") > 1)
    return _rounded(metrics.share_of_group(named, [], "pattern"), "share")


@query(
    "run_summary_counters",
    """SELECT o_orderpriority, count(*) AS simulations, count(DISTINCT o_custkey) AS tasks, round(avg(o_totalprice), 2) AS mean_cost,
       count(*) FILTER (o_orderstatus = 'F') AS db_match, count(*) FILTER (o_orderstatus = 'O') AS db_mismatch, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS db_not_checked
       FROM orders GROUP BY o_orderpriority""",
)
def run_summary_counters(t: Tables) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    flags = metrics.three_way(flag)
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("simulations"), F.count_distinct("o_custkey").alias("tasks"), F.round(F.avg("o_totalprice"), 2).alias("mean_cost"), *(F.count_if(f).alias(name) for name, f in flags.items())
    )


@query(
    "termination_counters",
    """SELECT c_mktsegment, count(*) FILTER (event_type = 'view') AS user_stop, count(*) FILTER (event_type = 'click') AS agent_stop,
       count(*) FILTER (event_type NOT IN ('view', 'click')) AS other FROM events JOIN customer ON user_id = c_custkey GROUP BY 1""",
)
def termination_counters(t: Tables) -> DataFrame:
    rows = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
    kind = F.col("event_type")
    return metrics.counters(rows, ["c_mktsegment"], user_stop=kind == "view", agent_stop=kind == "click", other=~kind.isin("view", "click"))


@query(
    "severity_maps",
    """SELECT l_orderkey % 50 AS sim, l_returnflag AS source, CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.05 THEN 'minor' ELSE 'unknown' END AS severity, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def severity_maps(t: Tables) -> DataFrame:
    errors = t.lineitem.select((F.col("l_orderkey") % 50).alias("sim"), F.col("l_returnflag").alias("source"), F.when(F.col("l_discount") >= 0.09, "critical").when(F.col("l_discount") >= 0.05, "minor").alias("severity"))
    return metrics.severity_counts(errors, ["sim"])


@query(
    "worst_severity",
    """WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.05 THEN 'minor' END AS s FROM lineitem)
       SELECT l_orderkey, CASE WHEN bool_or(coalesce(s = 'critical', false)) THEN 'critical' WHEN bool_or(coalesce(s = 'minor', false)) THEN 'minor' ELSE 'none' END AS worst FROM e GROUP BY 1""",
)
def worst_severity(t: Tables) -> DataFrame:
    errors = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("idx"), F.when(F.col("l_discount") >= 0.09, "critical").when(F.col("l_discount") >= 0.05, "minor").alias("severity"))
    return metrics.worst_severity(errors, "l_orderkey")


@query(
    "first_critical_source",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.02 THEN l_quantity ELSE l_linenumber END, l_linenumber * 1000000 + l_partkey, l_returnflag) AS n FROM lineitem WHERE l_discount >= 0.05),
       f AS (SELECT l_orderkey, l_returnflag FROM e WHERE n = 1)
       SELECT o.l_orderkey, coalesce(f.l_returnflag, 'none') AS first_critical FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f USING (l_orderkey)""",
)
def first_critical_source(t: Tables) -> DataFrame:
    errors = t.lineitem.select(
        "l_orderkey", F.col("l_returnflag").alias("source"), F.when(F.col("l_discount") >= 0.05, "critical_hindered").otherwise("minor").alias("severity"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("tick_start"), F.col("l_linenumber").alias("turn_idx"), F.struct(F.col("l_linenumber") * 1000000 + F.col("l_partkey"), "l_returnflag").alias("idx"),
    )
    return metrics.first_critical_source(errors, "l_orderkey")


@query(
    "cost_by_role",
    """SELECT l_orderkey, l_linestatus, CASE WHEN count(*) FILTER (l_discount <= 0.0) = 0 THEN round(sum(l_extendedprice), 2) END AS cost FROM lineitem WHERE l_linestatus <> 'tool' GROUP BY ALL""",
)
def cost_by_role(t: Tables) -> DataFrame:
    priced = t.lineitem.withColumn("cost", F.when(F.col("l_discount") > 0.0, F.col("l_extendedprice")))
    return _rounded(metrics.total_cost(priced, "l_orderkey", "l_linestatus", "cost"), "cost", digits=2)


@query("success_ratio", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS ratio FROM orders GROUP BY 1")
def success_ratio(t: Tables) -> DataFrame:
    return metrics.success_ratio(t.orders.withColumn("reward", F.when(_success(), 1.0 - 1e-7).otherwise(0.0)), ["o_orderpriority"], "reward")


@query(
    "trials_not_run",
    "SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) = 10 AS complete FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def trials_not_run(t: Tables) -> DataFrame:
    """Whether each task of the spine has its trials, zero-filled."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").fillna({"n": 0}).withColumn("complete", F.col("n") == 10)


@query(
    "rates_and_medians",
    """SELECT l_suppkey % 20 AS g, round(coalesce(count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_linestatus = 'F'), 0), 0), 6) AS or_zero,
       round(count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_quantity > 1000), 0), 6) AS or_blank, median(CASE WHEN l_discount > 0.02 THEN l_extendedprice END) AS middle FROM lineitem GROUP BY 1""",
)
def rates_and_medians(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(c)
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("g")).agg(
        n(F.col("l_returnflag") == "R").alias("r"), n(F.col("l_linestatus") == "F").alias("f"), n(F.col("l_quantity") > 1000).alias("z"), stats.median_present(F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice"))).alias("middle")
    )
    return rows.select("g", F.round(stats.rate_or_zero("r", "f", 9), 6).alias("or_zero"), stats.rate_or_blank("r", "z").alias("or_blank"), "middle")


@query(
    "line_fit_by_flag",
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
)
def line_fit_by_flag(t: Tables) -> DataFrame:
    slope, intercept, r2 = stats.line_fit("l_quantity", "l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(slope, 3).alias("slope"), F.round(intercept, 2).alias("intercept"), F.round(r2, 6).alias("r2"))


@query(
    "price_histogram",
    "SELECT least(CAST(floor(l_discount / 0.01 + 1e-9) AS INTEGER), 9) AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1",
)
def price_histogram(t: Tables) -> DataFrame:
    return t.lineitem.select(stats.histogram_bin(F.round(F.col("l_discount") * 100), 0, 10, 10).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("quartiles_by_flag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1")
def quartiles_by_flag(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(stats.quartiles("l_quantity").alias("q")).select("l_returnflag", *(F.col("q")[k].alias(f"q{k + 1}") for k in range(3)))
