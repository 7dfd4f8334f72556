"""Dedupe, pivots, grouping sets, correlations, shares, spines, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import correlation
from sparkloom.operators import analytics, joins, metrics, reconcile, sampling, topk, windows
from sparkloom.plans.catalog import Tables, query


def _year_segment(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.withColumn("year", F.year("l_shipdate"))


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(
    "best_run_dedupe",
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey DESC) = 1""",
)
def best_run_dedupe(t: Tables) -> DataFrame:
    """The best run of each cell (A11, W03): an aggregation, no sort."""
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    best = windows.keep_best(rows, ["o_custkey", "o_orderpriority"], [F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_orderkey")])
    return best.drop("o_orderstatus")


@query("keep_last_dedupe", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last_dedupe(t: Tables) -> DataFrame:
    return windows.keep_last(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "metric_unpivot",
    """WITH w AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS quantity, avg(CASE WHEN l_returnflag <> 'A' THEN l_discount END) AS discount FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, metric, round(value, 6) AS value FROM (SELECT l_returnflag, l_linestatus, 'quantity' AS metric, quantity AS value FROM w UNION ALL SELECT l_returnflag, l_linestatus, 'discount', discount FROM w) WHERE value IS NOT NULL""",
)
def metric_unpivot(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("quantity"), F.avg(F.when(F.col("l_returnflag") != "A", F.col("l_discount"))).alias("discount"))
    return analytics.unpivot_metrics(wide, ["l_returnflag", "l_linestatus"], ["quantity", "discount"]).withColumn("value", F.round("value", 6))


@query(
    "metric_pivot",
    """SELECT l_linestatus, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 4) AS A, round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 4) AS N, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS R, CAST(NULL AS DOUBLE) AS X
       FROM lineitem GROUP BY 1""",
)
def metric_pivot(t: Tables) -> DataFrame:
    """A fixed column order; a name without rows is NULL."""
    out = analytics.pivot_means(t.lineitem, ["l_linestatus"], "l_returnflag", "l_extendedprice", ["A", "N", "R", "X"])
    return out.withColumns({c: F.round(c, 4) for c in "ANRX"})


@query(
    "pivot_sums",
    "SELECT l_linestatus, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS A, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'X'), 0), 2) AS X FROM lineitem GROUP BY 1",
)
def pivot_sums(t: Tables) -> DataFrame:
    out = analytics.pivot_sums(t.lineitem, ["l_linestatus"], "l_returnflag", "l_quantity", ["A", "X"])
    return out.withColumns({c: F.round(c, 2) for c in "AX"})


@query(
    "failure_share_grouping_sets",
    f"""WITH g AS (SELECT c_mktsegment, year(l_shipdate) AS year, count(*) FILTER (l_returnflag = 'R') AS failures, count(*) FILTER (l_returnflag <> 'N') AS relevant, count(*) AS n, grouping(c_mktsegment, year(l_shipdate)) AS summary_level
        FROM {_LINES} GROUP BY GROUPING SETS ((), (c_mktsegment), (year(l_shipdate)), (c_mktsegment, year(l_shipdate))))
        SELECT c_mktsegment, year, CAST(failures AS BIGINT) AS failures, CAST(relevant AS BIGINT) AS relevant, n, summary_level, round_even(coalesce(failures / nullif(sum(failures) OVER (PARTITION BY summary_level), 0), 0), 6) AS failure_share, round_even(coalesce(failures / nullif(relevant, 0), 0), 6) AS failure_rate FROM g""",
)
def failure_share_grouping_sets(t: Tables) -> DataFrame:
    return analytics.share_by_levels(_year_segment(t), [[], ["c_mktsegment"], ["year"], ["c_mktsegment", "year"]], F.col("l_returnflag") == "R", F.col("l_returnflag") != "N")


@query(
    "top_failure_cells",
    f"""SELECT c_mktsegment, year(l_shipdate) AS year, count(*) FILTER (l_returnflag = 'R') AS failures FROM {_LINES} GROUP BY ALL ORDER BY failures DESC, c_mktsegment, year LIMIT 10""",
)
def top_failure_cells(t: Tables) -> DataFrame:
    """The largest cells of one level."""
    return _year_segment(t).groupBy("c_mktsegment", "year").agg(F.count_if(F.col("l_returnflag") == "R").alias("failures")).orderBy(F.desc("failures"), "c_mktsegment", "year").limit(10)


@query(
    "metric_correlations_cube",
    f"""SELECT c_mktsegment, l_returnflag, grouping(c_mktsegment, l_returnflag) AS summary_level, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r_price, round(corr(l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END), 6) AS r_discount, CAST(NULL AS DOUBLE) AS r_constant
        FROM {_LINES} GROUP BY GROUPING SETS ((), (c_mktsegment), (l_returnflag), (c_mktsegment, l_returnflag))""",
)
def metric_correlations_cube(t: Tables) -> DataFrame:
    """Correlations at four levels; a constant side gives NULL."""
    rows = _year_segment(t).select("c_mktsegment", "l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"), F.lit(0.1).alias("constant"))
    out = analytics.correlations_by_levels(rows, [[], ["c_mktsegment"], ["l_returnflag"], ["c_mktsegment", "l_returnflag"]], [("q", "price"), ("q", "discount"), ("q", "constant")])
    return out.select("c_mktsegment", "l_returnflag", "summary_level", "n", *(F.round(f"r_q_{c}", 6).alias(f"r_{c}") for c in ("price", "discount", "constant")))


@query("correlation_matrix", "SELECT 'l_discount' AS x, 'l_tax' AS y, round(corr(l_discount, l_tax), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', 1.0 UNION ALL SELECT 'l_tax', 'l_tax', 1.0")
def correlation_matrix(t: Tables) -> DataFrame:
    return analytics.correlation_matrix(t.lineitem, ["l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


@query("pearson_by_flag", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_by_flag(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(correlation("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    "mean_error_count",
    "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS sd, count(p_retailprice) AS n, round(stddev_samp(p_retailprice) / sqrt(greatest(count(p_retailprice), 1)), 4) AS sem FROM part WHERE p_brand IS NOT NULL GROUP BY 1",
)
def mean_error_count(t: Tables) -> DataFrame:
    return analytics.mean_error_count(t.part, ["p_brand"], "p_retailprice").withColumns({c: F.round(c, 4) for c in ("mean", "sd", "sem")})


@query("population_deviation", "SELECT p_brand, round(avg(p_size), 4) AS mean, round(stddev_pop(p_size), 4) AS sd FROM part GROUP BY 1")
def population_deviation(t: Tables) -> DataFrame:
    return analytics.mean_and_deviation(t.part, ["p_brand"], "p_size", population=True).withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query(
    "mean_by_bucket",
    """WITH b AS (SELECT unnest(range(0, 60, 10)) AS bucket), n AS (SELECT CAST(p_size // 10 * 10 AS BIGINT) AS bucket, avg(p_retailprice) AS mean, count(*) AS n FROM part GROUP BY 1)
       SELECT CAST(b.bucket AS BIGINT) AS bucket, round(coalesce(mean, 0), 4) AS mean, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM part), 6) AS share FROM b LEFT JOIN n USING (bucket)""",
)
def mean_by_bucket(t: Tables) -> DataFrame:
    rows = t.part.withColumn("bucket", (F.floor(F.col("p_size") / 10) * 10).cast("long"))
    out = analytics.by_bucket(rows, "bucket", "p_retailprice", t.spark.range(0, 60, 10).withColumnRenamed("id", "bucket"))
    return out.withColumns({"mean": F.round("mean", 4), "share": F.round("share", 6)})


@query(
    "language_run_summary",
    """WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE trim(coalesce(lang, '')) <> '' GROUP BY ALL), s AS (SELECT source, lang, n, round_even(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM n)
       SELECT source, CAST(sum(n) AS BIGINT) AS n, string_agg(lang || '_' || printf('%.3f', share), '|' ORDER BY n DESC, lang) AS distribution FROM s GROUP BY 1""",
)
def language_run_summary(t: Tables) -> DataFrame:
    return analytics.distribution(t.documents, ["source"], "lang").select("source", "n", "distribution")


@query("top_languages", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS INTEGER) AS place FROM c QUALIFY place <= 2")
def top_languages(t: Tables) -> DataFrame:
    return analytics.top_per_group(t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), ["source"], [F.desc("n"), F.col("lang")], 2)


@query("row_shares", "SELECT s_suppkey, round(s_suppkey / nullif(s_suppkey + s_nationkey, 0), 6) AS a, round(s_nationkey / nullif(s_suppkey + s_nationkey, 0), 6) AS b FROM supplier")
def row_shares(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return analytics.normalise_rows(rows, ["a", "b"]).withColumns({c: F.round(c, 6) for c in "ab"})


@query(
    "compare_experiments",
    """WITH w AS (SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') END AS a, CASE WHEN count(*) FILTER (o_orderpriority = '5-LOW') > 0 THEN count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') END AS b FROM orders GROUP BY 1)
       SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = b THEN 'same' WHEN a < b THEN 'better' ELSE 'worse' END AS label, count(*) AS n FROM w GROUP BY 1""",
)
def compare_experiments(t: Tables) -> DataFrame:
    """Tasks side by side in two runs, with a label."""
    return analytics.compare_runs(t.orders, "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F", ["1-URGENT", "5-LOW"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gap_to_baseline",
    """SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS baseline, round(avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING'), 4) AS others, round(avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS gap
       FROM customer GROUP BY 1 HAVING baseline IS NOT NULL AND others IS NOT NULL""",
)
def gap_to_baseline(t: Tables) -> DataFrame:
    return analytics.against_baseline(t.customer, ["c_nationkey"], "c_mktsegment", "BUILDING", "c_acctbal").withColumns({c: F.round(c, 4) for c in ("baseline", "others", "gap")})


@query("action_frequency", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def action_frequency(t: Tables) -> DataFrame:
    return metrics.share_of_group(t.events, [], "event_type").withColumn("share", F.round("share", 6))


@query("bootstrap_ci")
def bootstrap_ci(t: Tables) -> DataFrame:
    """Intervals of mean prices by flag, from means by supplier."""
    means = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("mean"))
    return analytics.bootstrap_means(means, ["l_returnflag"], "mean", low=0.0, high=1.0)


@query(
    "bootstrap_by_draws",
    """WITH means AS (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
       ranked AS (SELECT c_mktsegment, m, row_number() OVER (PARTITION BY c_mktsegment ORDER BY m) - 1 AS j, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM means),
       draws AS (SELECT c_mktsegment, b, CAST(floor(n * (CAST('0x' || left(md5(concat_ws('|', c_mktsegment, b, j, '20260625')), 13) AS BIGINT) / 4503599627370496.0::DOUBLE)) AS BIGINT) AS j FROM ranked, (SELECT unnest(range(1000)) AS b)),
       resampled AS (SELECT d.c_mktsegment, d.b, avg(r.m) AS m FROM draws d JOIN ranked r ON d.c_mktsegment = r.c_mktsegment AND d.j = r.j GROUP BY ALL),
       bounds AS (SELECT c_mktsegment, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM resampled GROUP BY 1)
       SELECT c_mktsegment, round(avg(m), 4) AS estimate, round(any_value(low), 4) AS ci_low, round(any_value(high), 4) AS ci_high FROM means JOIN bounds USING (c_mktsegment) GROUP BY 1""",
)
def bootstrap_by_draws(t: Tables) -> DataFrame:
    """Intervals of mean prices by segment, from means by customer, in groups of any size."""
    means = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.avg("o_totalprice").alias("m"))
    found = analytics.bootstrap_draws(means, ["c_mktsegment"], "m")
    return found.withColumns({c: F.round(c, 4) for c in ("estimate", "ci_low", "ci_high")})


@query("leaderboard_topk", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank FROM supplier QUALIFY rank <= 20")
def leaderboard_topk(t: Tables) -> DataFrame:
    return topk.leaderboard(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal", ["s_suppkey"], 20).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query(
    "mean_over_present",
    "SELECT c_custkey, round((CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END + c_nationkey) / (CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END), 6) AS mean, CAST(CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS INTEGER) AS present FROM customer",
)
def mean_over_present(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return topk.mean_over_present(rows, "c_custkey", ["a", "b"]).withColumn("mean", F.round("mean", 6))


@query("newest_first", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS date_issued FROM orders ORDER BY date_issued DESC, o_orderkey LIMIT 12")
def newest_first(t: Tables) -> DataFrame:
    """By date as text, as records hold it."""
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("issue_date"), F.lit(None).cast("string").alias("created"))
    return topk.newest_first(rows, ["created", "issue_date"], ["o_orderkey"], 12).select("o_orderkey", "date_issued")


@query(
    "greedy_trim",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total,
         coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM r WHERE total - before > 60""",
)
def greedy_trim(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumn("total", F.sum("l_quantity").over(Window.partitionBy("l_orderkey")))
    out = topk.greedy_until(rows, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], F.col("l_quantity"), F.col("total"), 60)
    return out.drop("total")


@query("name_map", "SELECT n_name, CAST(max(n_nationkey) AS INTEGER) AS n_nationkey FROM nation GROUP BY 1")
def name_map(t: Tables) -> DataFrame:
    return topk.name_map(t.nation.select("n_name", "n_nationkey"), "n_name", "n_nationkey", "n_nationkey")


@query(
    "set_reconciliation",
    """WITH r AS (SELECT DISTINCT o_custkey + 10 AS id FROM orders)
       SELECT c_custkey, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'right' FROM r WHERE id NOT IN (SELECT c_custkey FROM customer)""",
)
def set_reconciliation(t: Tables) -> DataFrame:
    """Ids that only one of two tables has."""
    return reconcile.id_diff(t.customer, t.orders.select((F.col("o_custkey") + 10).alias("c_custkey")), "c_custkey")


@query(
    "hash_diff",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'added' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 <> 0",
)
def hash_diff(t: Tables) -> DataFrame:
    """Rows added, removed and changed between two states of a table."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    left = rows.where("o_orderkey % 3 <> 0 OR o_orderkey % 10 = 0")
    right = rows.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return reconcile.row_diff(left, right, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("value_diff", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS left_value, 'X' AS right_value FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus IS DISTINCT FROM 'X'")
def value_diff(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    right = left.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return reconcile.value_diff(left, right, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(
    "deep_diff",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT event_id, '$["a"]["k"]' AS path, 'changed' AS change, CAST(k AS VARCHAR) AS left_value, CAST(k + 1 AS VARCHAR) AS right_value FROM e WHERE event_type = 'click'
       UNION ALL SELECT event_id, '$["n"]', 'removed', '1', NULL FROM e WHERE event_type = 'view' UNION ALL SELECT event_id, '$["t"][1]', 'type', CAST(k AS VARCHAR), CAST(k AS VARCHAR) FROM e WHERE event_type = 'error'
       UNION ALL SELECT event_id, '$["t"][2]["x"][0]', 'added', NULL, 'new' FROM e WHERE event_type = 'signup'""",
)
def deep_diff(t: Tables) -> DataFrame:
    """Differences of nested records at any depth (R04, R05, R11): a changed number, a lost field, another type, a longer array, and none for another order or spelling of numbers."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    left = F.concat(F.lit('{"a": {"k": '), k, F.lit(', "u": []}, "t": ["'), kind, F.lit('", '), k, F.lit('], "n": 1}'))
    bigger = F.when(kind == "click", (k.cast("long") + 1).cast("string")).otherwise(k)
    second = F.when(kind == "error", F.concat(F.lit('"'), k, F.lit('"'))).when(kind == "purchase", F.concat(k, F.lit(".0"))).otherwise(k)
    more = F.when(kind == "signup", ', {"x": ["new"]}').otherwise("")
    right = F.concat(F.when(kind == "view", "{").otherwise('{"n": 1, '), F.lit('"t": ["'), kind, F.lit('", '), second, more, F.lit('], "a": {"u": [], "k": '), bigger, F.lit("}}"))
    return reconcile.deep_diff(t.events.select("event_id", left.alias("j")), t.events.select("event_id", right.alias("j")), "event_id", "j")


@query("still_to_do", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'O')")
def still_to_do(t: Tables) -> DataFrame:
    """Orders none of whose lines is done; lines that the infrastructure ended don't count."""
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "O", "infrastructure_error").alias("termination"))
    return reconcile.still_to_do(t.orders.select("o_orderkey"), done, ["o_orderkey"], "termination")


@query("metric_mismatch", "SELECT o_custkey, count(*) AS reported_n, count(*) + 1 AS computed_n FROM orders WHERE o_custkey % 11 = 0 GROUP BY 1")
def metric_mismatch(t: Tables) -> DataFrame:
    reported = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    computed = reported.withColumn("n", F.when(F.col("o_custkey") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return reconcile.metric_mismatch(reported, computed, "o_custkey", ["n"])


@query("uniqueness", "SELECT count(n_name) = count(DISTINCT n_name) AS unique_n_name, count(n_regionkey) = count(DISTINCT n_regionkey) AS unique_n_regionkey, count(DISTINCT n_regionkey) <= 1 AS single_n_regionkey FROM nation")
def uniqueness(t: Tables) -> DataFrame:
    return reconcile.uniqueness(t.nation, ["n_name", "n_regionkey"], ["n_regionkey"])


@query("counts_equal", "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM customer) AS equal")
def counts_equal(t: Tables) -> DataFrame:
    return reconcile.counts_equal(t.orders, t.customer)


@query(
    "stratified_sample",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) <= 5",
)
def stratified_sample(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sampling.stratified_sample(rows, ["o_orderstatus", "o_orderpriority"], 5, [F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey")])


_U = "CAST('0x' || left(md5(p_partkey || '|7'), 13) AS BIGINT) / 4503599627370496.0"


@query("weighted_choice", f"SELECT p_partkey, CASE WHEN u < 0.5 THEN 'en' WHEN u < 0.8 THEN 'de' ELSE 'fr' END AS choice FROM (SELECT p_partkey, {_U} AS u FROM part)")
def weighted_choice(t: Tables) -> DataFrame:
    return sampling.weighted_choice(t.part.select("p_partkey"), ["p_partkey"], {"en": 0.5, "de": 0.3, "fr": 0.2}, 7)


@query("quota_blocks", f"SELECT p_partkey, CASE WHEN n < 0.5 THEN 'en' WHEN n < 0.8 THEN 'de' ELSE 'fr' END AS choice FROM (SELECT p_partkey, (row_number() OVER (ORDER BY {_U}, p_partkey) - 1) / count(*) OVER () AS n FROM part)")
def quota_blocks(t: Tables) -> DataFrame:
    return sampling.quota_blocks(t.part.select("p_partkey"), ["p_partkey"], {"en": 0.5, "de": 0.3, "fr": 0.2}, 7)


@query("dimension_lookup", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(t: Tables) -> DataFrame:
    """Hash left joins to dimensions."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.lookup(joins.lookup(orders, t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_custkey"]), nations, ["c_nationkey"])
    return out.select("o_orderkey", "c_mktsegment", "n_name")


@query("refreshed_metrics", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def refreshed_metrics(t: Tables) -> DataFrame:
    newer = t.customer.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return joins.refreshed(t.customer.select("c_custkey", "c_acctbal"), newer, ["c_custkey"], ["c_acctbal"])


@query("routed_lookup", "SELECT 'c:' || c_custkey AS id, c_name AS found FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'x:1', NULL")
def routed_lookup(t: Tables) -> DataFrame:
    """The ids of all customers and suppliers looked up by their prefix."""
    ids = t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("id")).union(t.supplier.select(F.concat(F.lit("s:"), "s_suppkey"))).union(t.spark.createDataFrame([("x:1",)], "id string"))
    routes = {"c": (t.customer.withColumn("name", F.col("c_name")), "c_custkey"), "s": (t.supplier.withColumn("name", F.col("s_name")), "s_suppkey")}
    return joins.routed_lookup(ids, "id", routes, "name").select("id", "found")


@query("over_grid", "SELECT r_name, lang FROM region, (VALUES ('en'), ('th'), ('vi')) v(lang)")
def over_grid(t: Tables) -> DataFrame:
    return joins.over_grid(t.region.select("r_name"), ["en", "th", "vi"], "lang")
