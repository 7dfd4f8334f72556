"""Nested records, point lookups, traces as rows, sinks and streams over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import stats, text
from sparkloom.functions.registry import batched
from sparkloom.operators import analytics, flatten, joins, lookups, metrics, scoring, ticks
from sparkloom.plans.catalog import Tables, query
from sparkloom.sources import sinks
from sparkloom.sources.workspace import settings, workspace
from sparkloom.streaming import stateful, turns


#: Lines whose orders a task holds at most, about.
LINES = 250_000


def order_records(t: Tables) -> DataFrame:
    """Orders as nested records: lines as actions with checks, a reward over a basis."""
    # Lines are gathered as what differs between them; a check's texts are put in afterwards.
    line = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "N").alias("read"), (F.col("l_linestatus") == "F").alias("match"))
    # A number of parts of their own, as parts of few bytes are put together however many rows they unfold to.
    parts = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES))
    dealt = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition(parts, "l_orderkey")
    lines = dealt.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), F.min((F.col("l_linestatus") == "F").cast("double")).alias("action"))

    def check(x: Column) -> Column:
        kind = F.when(x["read"], "read").otherwise("write")
        action = F.struct(F.concat_ws("-", F.col("l_orderkey"), x["n"]).alias("action_id"), F.lit("assistant").alias("requestor"), kind.alias("name"), F.lit("{}").alias("arguments"))
        return F.struct(action.alias("action"), x["match"].alias("action_match"), F.lit(1.0).alias("action_reward"), kind.alias("tool_type"))

    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("checks", F.transform("lines", check))
    db = (F.col("o_orderstatus") == "F").cast("double")
    basis = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("DB"), F.lit("ACTION"))).otherwise(F.array(F.lit("DB")))
    reward = F.struct(db.alias("reward"), F.struct((db == 1.0).alias("db_match"), db.alias("db_reward")).alias("db_check"), F.col("checks").alias("action_checks"), basis.alias("reward_basis"), F.create_map(F.lit("DB"), db, F.lit("ACTION"), F.coalesce("action", F.lit(1.0))).alias("reward_breakdown"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.lit(0).alias("trial"), reward.alias("reward_info"))


@query(
    "reward_flags",
    """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS w, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS m, bool_and(l_linestatus = 'F') AS a FROM lineitem GROUP BY 1)
       SELECT o_orderkey AS id, o_custkey AS task_id, 0 AS trial, o_orderstatus = 'F' AS db_met, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(a, true) END AS action_met, CAST(NULL AS BOOLEAN) AS communicate_met, CAST(w AS INTEGER) AS num_writes, CAST(m AS INTEGER) AS num_writes_met
       FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
)
def reward_flags(t: Tables) -> DataFrame:
    """What was met of each reward, NULL for what isn't in its basis."""
    return flatten.reward_flags(order_records(t), ["write"])


@query("action_check_rows", "SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'N' THEN 'read' ELSE 'write' END AS name, l_linestatus = 'F' AS matched, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def action_check_rows(t: Tables) -> DataFrame:
    """Checks exploded to rows."""
    return flatten.action_check_rows(order_records(t)).groupBy("id", "name", "matched").agg(F.count(F.lit(1)).alias("n"))


@query("light_index", "SELECT o_orderkey AS id, o_custkey AS task_id, CAST(o_orderstatus = 'F' AS DOUBLE) AS reward, o_totalprice AS agent_cost FROM orders")
def light_index(t: Tables) -> DataFrame:
    """The index of simulations."""
    sims = order_records(t).join(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("termination_reason"), F.col("o_totalprice").alias("agent_cost"), F.lit(None).cast("double").alias("duration")), "id")
    return sinks.simulation_index(sims).select("id", "task_id", "reward", "agent_cost")


@query(
    "task_metrics",
    "SELECT l_orderkey AS id, CAST(CASE WHEN count(*) = 1 AND max(l_returnflag) = 'R' THEN -1 ELSE count(*) END AS INTEGER) AS num_actions, CAST(count(*) FILTER (l_linestatus = 'F') AS INTEGER) AS num_agent_actions, CAST(count(*) FILTER (l_linestatus <> 'F') AS INTEGER) AS num_user_actions, 0 AS num_env_assertions, 1 AS num_nl_assertions FROM lineitem GROUP BY 1",
)
def task_metrics(t: Tables) -> DataFrame:
    """Counts of gold actions; -1 for a task that only transfers."""
    action = F.struct(F.lit("").alias("action_id"), F.when(F.col("l_linestatus") == "F", "assistant").otherwise("user").alias("requestor"), F.when(F.col("l_returnflag") == "R", "Transfer_to_human").otherwise("x").alias("name"), F.lit("").alias("arguments"), F.lit(None).cast("array<string>").alias("compare_args"))
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(action).alias("a"))
    criteria = F.struct(F.col("a").alias("actions"), F.lit(None).cast("array<string>").alias("env_assertions"), F.array(F.lit("x")).alias("nl_assertions"))
    return flatten.task_metrics(tasks.select("id", criteria.alias("evaluation_criteria")))


@query("domain_table", "SELECT n_nationkey, unnest(['air', 'sea']) AS domain, unnest([CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)]) AS pass_1 FROM nation")
def domain_table(t: Tables) -> DataFrame:
    """A wide board as long rows."""
    wide = t.nation.select("n_nationkey", F.col("n_nationkey").cast("double").alias("air_pass_1"), F.col("n_regionkey").cast("double").alias("sea_pass_1"))
    return flatten.domain_table(wide, ["n_nationkey"], ["air", "sea"], ["pass_1"])


@query("trimmed_records", "SELECT o_orderkey, CAST(11 * count(l_orderkey) + 10 + length(any_value(o_orderpriority)) AS INTEGER) AS saved_bytes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def trimmed_records(t: Tables) -> DataFrame:
    """Fields dropped within arrays and beside them, with the bytes saved."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))).alias("messages"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("messages", F.array()).alias("messages"), F.col("o_orderpriority").alias("junk"))
    return sinks.trimmed(rows, ["flag"], ["junk"]).select("o_orderkey", "saved_bytes")


@query("string_leaves", "SELECT event_type AS leaf, count(*) AS n FROM events GROUP BY 1")
def string_leaves(t: Tables) -> DataFrame:
    """Strings anywhere in JSON."""
    nested = t.events.select("event_id", F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("kind"), F.col("value"))).alias("a"))).alias("j"))
    return flatten.string_leaves(nested, "event_id", "j").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


@query("leaf_totals", "SELECT event_id, CAST(2 AS BIGINT) AS leaves, CAST(length(event_type) + 2 AS BIGINT) AS characters FROM events")
def leaf_totals(t: Tables) -> DataFrame:
    """How many strings a record holds, and their characters."""
    nested = t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.lit("xy").alias("c"), F.col("value")).alias("b"))).alias("j"))
    return flatten.leaf_totals(nested, "event_id", "j")


@query(
    "markdown_sections",
    r"""WITH d AS (SELECT conv_id, '# Conversation' || chr(10) || string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS md FROM conversations GROUP BY 1),
       s AS (SELECT conv_id, string_split(md, chr(10)) AS lines FROM d),
       l AS (SELECT conv_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
       h AS (SELECT *, regexp_matches(line, '^#{1,6}\s') AS heading, sum(CAST(regexp_matches(line, '^#{1,6}\s') AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY pos) AS section FROM l),
       c AS (SELECT conv_id, section, string_agg(line, chr(10) ORDER BY pos) AS body, max(CASE WHEN heading THEN regexp_replace(line, '^#{1,6}\s+', '') END) AS title FROM h GROUP BY ALL),
       g AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS slug FROM c)
       SELECT conv_id, printf('%03d', row_number() OVER (PARTITION BY conv_id ORDER BY section)) || '_' || slug || '_' || row_number() OVER (PARTITION BY conv_id, slug ORDER BY section) AS section_id, title, body FROM g""",
)
def markdown_sections(t: Tables) -> DataFrame:
    """Whole conversations as Markdown, a heading for each turn, cut at the headings."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    parts = F.transform(turns, lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"]))
    docs = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("# Conversation\n"), F.array_join(parts, "\n")).alias("md"))
    return flatten.markdown_sections(docs, "conv_id", "md").select("conv_id", "section_id", "title", "body")


@query(
    "review_errors",
    "SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'user' ELSE 'agent' END AS source, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT l_orderkey, 'user', count(*) FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1",
)
def review_errors(t: Tables) -> DataFrame:
    """Errors of full reviews, else of reviews of users only."""
    error = F.struct(F.when(F.col("l_returnflag") == "A", "user").when(F.col("l_returnflag") == "N", "odd").otherwise("agent").alias("source"), F.lit("minor").alias("severity"), F.col("l_linenumber").alias("turn_idx"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(error).alias("e"))
    full = F.when(F.col("id") % 2 == 0, F.struct(F.col("e").alias("errors")))
    sims = rows.select("id", full.alias("review"), F.struct(F.col("e").alias("errors")).alias("user_only_review"))
    return flatten.review_errors(sims).groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    """One record by key; the filter reaches the scan."""
    return lookups.by_key(t.customer, "c_custkey", 42).select("c_custkey", "c_name")


@query("lookup_by_text", "SELECT n_nationkey FROM nation WHERE lower(n_name) = lower('NaTiOn_3') ORDER BY n_nationkey LIMIT 1")
def lookup_by_text(t: Tables) -> DataFrame:
    """The first record whose text matches, case aside."""
    return lookups.by_text(t.nation, {"n_name": "NaTiOn_3"}, "n_nationkey").select("n_nationkey")


@query("map_lookup", "SELECT l_orderkey, round(sum(l_quantity), 2) AS found FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def map_lookup(t: Tables) -> DataFrame:
    """A value by key in each record's map."""
    sums = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    maps = sums.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    return lookups.in_map(maps, "m", "R").select("l_orderkey", "found")


@query("variant_owner", "SELECT p_brand, p_partkey AS variant FROM part WHERE p_partkey = 17")
def variant_owner(t: Tables) -> DataFrame:
    """The record that holds a variant."""
    products = t.part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.col("p_partkey")))).alias("variants"))
    return lookups.variant_owner(products, "p_brand", "variants", "17").select("p_brand", "variant")


@query(
    "direct_connections",
    """SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 20 = 3 AND strftime(ts, '%H:%M') >= '12:00'""",
)
def direct_connections(t: Tables) -> DataFrame:
    """Optional filters over a map by day; times compare as texts."""
    day = F.create_map(F.lit("d"), F.struct(F.when(F.col("event_type") == "click", "available").otherwise("landed").alias("status")))
    flights = t.events.select("event_id", (F.col("user_id") % 20).cast("string").alias("origin"), F.lit("x").alias("destination"), F.date_format("ts", "HH:mm").alias("departs"), day.alias("dates"))
    return lookups.direct_flights(flights, "d", origin="3", after="12:00").select("event_id")


@query("ids_of_record", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def ids_of_record(t: Tables) -> DataFrame:
    """Records that an array of ids names, newest first."""
    owner = t.orders.where("o_custkey = 7").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return lookups.ids_of(owner, "ids", t.orders, "o_orderkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 12).select("o_orderkey", "o_totalprice")


@query("billing_cycles", "SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 THEN make_date(year(o_orderdate), 1, day(o_orderdate)) ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) END AS cycle_end FROM orders")
def billing_cycles(t: Tables) -> DataFrame:
    """A month on, December keeping its year."""
    return t.orders.select("o_orderkey", lookups.billing_end(F.col("o_orderdate").cast("date")).alias("cycle_end"))


@query("owner_records", "SELECT source, count(*) AS n FROM (SELECT 'customer' AS source FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'orders' FROM orders WHERE o_custkey = 5) GROUP BY 1")
def owner_records(t: Tables) -> DataFrame:
    """All records of one owner from several tables."""
    tables = {"customer": t.customer.withColumn("owner", F.col("c_custkey")), "orders": t.orders.withColumn("owner", F.col("o_custkey"))}
    return lookups.everything_of(tables, "owner", 5).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("constant_relation", "SELECT code, city, count(c_custkey) AS customers FROM (VALUES ('BUILDING', 'Amsterdam'), ('MACHINERY', 'Berlin'), ('NONE', 'Nowhere')) v(code, city) LEFT JOIN customer ON c_mktsegment = code GROUP BY ALL")
def constant_relation(t: Tables) -> DataFrame:
    """A relation that is always the same, and what a table has of it."""
    fixed = t.spark.sql("SELECT * FROM VALUES ('BUILDING', 'Amsterdam'), ('MACHINERY', 'Berlin'), ('NONE', 'Nowhere') AS v(code, city)")
    return fixed.join(t.customer, F.col("code") == F.col("c_mktsegment"), "left").groupBy("code", "city").agg(F.count("c_custkey").alias("customers"))


@query("collection_counts", "SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS variants_entries FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def collection_counts(t: Tables) -> DataFrame:
    """Rows of a collection and entries of its nested maps."""
    products = t.part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_partkey", "p_size"))).alias("variants"))
    return flatten.nested_counts(products, ["variants"])


@query(
    "paired_calls",
    """WITH c AS (SELECT user_id, event_id % 7 AS call, event_id AS called FROM events WHERE event_type = 'view'), r AS (SELECT user_id, event_id % 7 AS call, min(event_id) AS answered FROM events WHERE event_type = 'click' GROUP BY ALL)
       SELECT c.user_id, c.call, c.called, r.answered, coalesce(r.answered > c.called, false) AS in_order FROM c LEFT JOIN r USING (user_id, call)""",
)
def paired_calls(t: Tables) -> DataFrame:
    """Calls with the result of the same id, and whether it comes after."""
    rows = t.events.withColumn("call_id", F.col("event_id") % 7)
    return joins.paired_calls(rows, ["user_id"], "event_id", "call_id", F.col("event_type") == "view", F.col("event_type") == "click")


@query(
    "segment_assignment",
    """WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey - 100 AS s, o_orderkey AS e FROM orders), p AS (SELECT o_custkey, o_orderkey + 37 AS at FROM orders)
       SELECT p.o_custkey, p.at, CAST(coalesce(min(s.n) FILTER (s.e >= p.at), max(s.n)) AS INTEGER) AS n FROM p LEFT JOIN s USING (o_custkey) GROUP BY ALL""",
)
def segment_assignment(t: Tables) -> DataFrame:
    """All orders as segments, and a point after each."""
    bounds = t.orders.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), (F.col("o_orderkey") - 100).alias("s"), F.col("o_orderkey").alias("e"))
    points = t.orders.select("o_custkey", (F.col("o_orderkey") + 37).alias("at"))
    return joins.assign_segment(points, bounds, ["o_custkey"], "at", "s", "e", "n")


@query("metric_spine", "SELECT lang, coalesce(n, 0) AS n FROM (VALUES ('en'), ('de'), ('th')) v(lang) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang)")
def metric_spine(t: Tables) -> DataFrame:
    """A fixed list of languages, 0 where there is nothing."""
    spine = t.spark.sql("SELECT * FROM VALUES ('en'), ('de'), ('th') AS v(lang)")
    return joins.onto_spine(spine, t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang"], {"n": 0})


@query("first_per_group", "SELECT c_mktsegment, c_nationkey, arg_min(c_acctbal, c_custkey) AS value FROM customer GROUP BY ALL")
def first_per_group(t: Tables) -> DataFrame:
    """The first row's value of each cell."""
    return t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.min_by("c_acctbal", "c_custkey").alias("value"))


@query("wide_interval", "SELECT max(greatest(s_acctbal, s_nationkey)) AS top FROM supplier")
def wide_interval(t: Tables) -> DataFrame:
    """The largest of two columns."""
    return t.supplier.agg(F.max(F.greatest(F.col("s_acctbal"), F.col("s_nationkey").cast("double"))).alias("top"))


@query("label_coverage", "SELECT quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def label_coverage(t: Tables) -> DataFrame:
    """Reviewed labels on documents, NULL where there are none."""
    return t.documents.join(t.labels, "doc_id", "left").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("language_classes", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'target' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS class FROM documents")
def language_classes(t: Tables) -> DataFrame:
    """Target language, English or another."""
    return t.documents.select("doc_id", text.target_class("lang", F.lit("de")).alias("class"))


@query("detected_turns", "SELECT role, CASE WHEN length(trim(text)) = 0 OR text IS NULL THEN NULL WHEN contains(text, 'e') THEN 'e' ELSE 'no_e' END AS detected, count(*) AS n FROM conversations GROUP BY ALL")
def detected_turns(t: Tables) -> DataFrame:
    """Turns labelled in batches by a detector."""
    detect = batched(lambda: lambda texts: ["e" if "e" in x else "no_e" for x in texts])
    return t.conversations.select("role", detect("text").alias("detected")).groupBy("role", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drift_summary",
    """WITH e AS (SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long FROM documents GROUP BY ALL), s AS (SELECT source, sum(n) AS n, sum(long) AS long FROM e GROUP BY 1)
       SELECT source, CAST(n AS BIGINT) AS n, round_even(long / nullif(n, 0), 6) AS rate, (SELECT count(DISTINCT lang) FROM documents d WHERE d.source = s.source) AS languages FROM s""",
)
def drift_summary(t: Tables) -> DataFrame:
    """Shares and distinct counts by many keys at once."""
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_distinct("lang").alias("languages")).select("source", "n", stats.rate_or_blank("long", "n").alias("rate"), "languages")


@query("auth_classes", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'succeeded' WHEN o_orderpriority = '2-HIGH' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'not_checked' ELSE 'not_needed' END AS class, count(*) AS n FROM orders GROUP BY 1")
def auth_classes(t: Tables) -> DataFrame:
    """Statuses outside the known are not needed."""
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "succeeded").when(F.col("o_orderpriority") == "2-HIGH", "failed").when(F.col("o_orderpriority") == "5-LOW", None).otherwise("whatever")
    return t.orders.select(metrics.auth_class(status).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("tick_pieces", "SELECT conv_id, turn, role, list_transform(range(4), lambda i: CAST(length(text) * (i + 1) // 4 - length(text) * i // 4 AS INTEGER)) AS lengths, md5(text) AS whole FROM conversations")
def tick_pieces(t: Tables) -> DataFrame:
    """Texts cut evenly into chunks, which put together are the text."""
    parts = t.conversations.select("conv_id", "turn", "role", text.pieces("text", 4).alias("p"))
    return parts.select("conv_id", "turn", "role", F.transform("p", F.length).alias("lengths"), F.md5(F.array_join("p", "")).alias("whole"))


@query("open_intervals", "SELECT o_custkey, bool_or(o_orderdate <= TIMESTAMP '1995-06-17' AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1995-06-17')) AS is_open FROM orders GROUP BY 1")
def open_intervals(t: Tables) -> DataFrame:
    """Whether a key has an interval open at a time, NULL ends being open."""
    rows = t.orders.select("o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("until"))
    return ticks.open_at(rows, ["o_custkey"], "o_orderdate", "until", F.lit("1995-06-17 00:00:00").cast("timestamp_ntz"))


@query("combined_rewards", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 0.0::DOUBLE ELSE CAST(o_orderstatus = 'F' AS DOUBLE) END AS reward FROM orders")
def combined_rewards(t: Tables) -> DataFrame:
    """Products over each run's basis; runs cut short get 0."""
    parts = F.create_map(F.lit("DB"), (F.col("o_orderstatus") == "F").cast("double"), F.lit("TALK"), F.lit(1.0))
    return t.orders.select(F.col("o_orderkey").alias("id"), scoring.combined_reward(F.array(F.lit("DB"), F.lit("TALK")), parts, F.when(F.col("o_orderpriority") == "5-LOW", "max_steps").otherwise("user_stop")).alias("reward"))


@query("flat_calls", "SELECT conv_id, count(*) FILTER (role IN ('assistant', 'user')) AS n FROM conversations GROUP BY 1")
def flat_calls(t: Tables) -> DataFrame:
    """Tool calls of the speakers' messages, in order."""
    message = F.struct("turn", "role", F.array(F.struct(F.col("text").alias("name"))).alias("tool_calls"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", F.size(scoring.flat_calls("m")).cast("long").alias("n"))


@query("parameter_grid", "SELECT n_nationkey, k, b FROM nation, (VALUES ('1'), ('2')) x(k), (VALUES ('a'), ('b'), ('c')) y(b)")
def parameter_grid(t: Tables) -> DataFrame:
    """Rows for each choice of short lists."""
    return joins.over_grid(joins.over_grid(t.nation.select("n_nationkey"), ["1", "2"], "k"), ["a", "b", "c"], "b")


@query("upserted_table", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -5, 'new'")
def upserted_table(t: Tables) -> DataFrame:
    """Rows replaced by key and others added, the same when run twice."""
    table = t.customer.select("c_custkey", "c_mktsegment")
    new = table.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment")).union(t.spark.sql("SELECT -5L, 'new'"))
    return sinks.upsert(sinks.upsert(table, new, ["c_custkey"]), new, ["c_custkey"])


@query("csv_round_trip", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, printf('%.6f', s_acctbal) AS s_acctbal FROM supplier")
def csv_round_trip(t: Tables) -> DataFrame:
    """A CSV of six digits, written and read again."""
    path = workspace(t.spark, "csv")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_acctbal"), path, 6)
    return t.spark.read.option("header", True).schema("s_suppkey STRING, s_acctbal STRING").csv(path)


@query("json_round_trip", "SELECT o_orderkey AS id, o_custkey AS task_id, CAST(o_orderstatus = 'F' AS DOUBLE) AS reward FROM orders")
def json_round_trip(t: Tables) -> DataFrame:
    """Nested records written as JSON and read with their schema."""
    rows, path = order_records(t), workspace(t.spark, "json")
    sinks.write_results(rows, path)
    return t.spark.read.schema(rows.schema).json(path).select("id", "task_id", F.col("reward_info.reward").alias("reward"))


def _event_stream(t: Tables) -> DataFrame:
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    rows = stateful.event_stream(t.spark, t.folder, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(t: Tables) -> DataFrame:
    """A stream of files run to its end, written once."""
    out = workspace(t.spark, "stream")
    stateful.run_once(_event_stream(t), f"{out}/rows", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_closed_intervals",
    """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
       SELECT o.user_id, o.t AS opened_at, min(c.t) AS closed_at FROM e o JOIN e c ON c.user_id = o.user_id AND c.t > o.t AND c.d < o.d WHERE o.event_type = 'view' GROUP BY ALL""",
)
def stream_closed_intervals(t: Tables) -> DataFrame:
    """Intervals from a stream, last in first out."""
    out = workspace(t.spark, "stream")
    rows = _event_stream(t).select("user_id", F.unix_micros("ts").alias("at"), "event_type")
    stateful.run_once(stateful.stream_open_intervals(rows, "user_id", "at", "event_type", "view", "click"), f"{out}/rows", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/rows")


#: Events as a conversation's: what its two parties do, over hours.
TURN_POLICY = turns.Policy(wait_other=4 * 3_600_000, wait_self=8 * 3_600_000, interrupted=1, interrupting=2, interrupt_after=4, backchannel_after=2, backchannel_every=3, interval=2, overlap=12 * 3_600_000, idle=40 * 3_600_000)


@query(
    "turn_taking",
    """WITH RECURSIVE until AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS until FROM events),
       e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id AS id, CASE event_type WHEN 'click' THEN 'self' WHEN 'purchase' THEN 'backchannel' WHEN 'error' THEN 'tool' ELSE 'other' END AS kind,
               row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS pos FROM events, until WHERE epoch_us(ts) // 1000 < until),
       s AS (
         SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS self_at, CAST(NULL AS BIGINT) AS other_at,
                CAST(NULL AS BIGINT) AS self_began, CAST(NULL AS BIGINT) AS other_began, CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS since, false AS due, false AS telling FROM e
         UNION ALL
         SELECT user_id, pos, at_ms, id, kind, action, self_at, other_at, self_began, other_began, run, n, CASE WHEN kind = 'backchannel' OR action = 'backchannel' THEN 0 ELSE since END, due, telling
         FROM (SELECT *, CASE kind WHEN 'tool' THEN 'generate_message' WHEN 'backchannel' THEN 'keep_talking'
                  WHEN 'other' THEN CASE WHEN n % 2 = 0 AND run >= 4 THEN 'generate_message' WHEN n % 2 = 0 AND run >= 2 AND since >= 3 THEN 'backchannel' ELSE 'wait' END
                  ELSE CASE WHEN other_on AND run >= CASE WHEN telling OR self_began > other_began THEN 2 ELSE 1 END THEN 'stop_talking' ELSE 'keep_talking' END END AS action
               FROM (SELECT user_id, pos, at_ms, id, kind, other_on, n + 1 AS n, since + 1 AS since, CASE WHEN talks THEN at_ms ELSE self_at END AS self_at, CASE WHEN kind = 'other' THEN at_ms ELSE other_at END AS other_at,
                            CASE WHEN talks AND NOT self_on THEN at_ms ELSE self_began END AS self_began, CASE WHEN kind = 'other' AND NOT other_on THEN at_ms ELSE other_began END AS other_began,
                            CASE WHEN kind = 'other' THEN CASE WHEN other_on THEN run + 1 ELSE 1 END WHEN talks AND NOT other_on THEN 0 ELSE run END AS run,
                            CASE WHEN kind = 'tool' THEN true WHEN talks AND NOT self_on THEN false ELSE due END AS due, CASE WHEN talks AND NOT self_on THEN due ELSE telling END AS telling
                     FROM (SELECT *, kind IN ('self', 'backchannel') AS talks, coalesce(at_ms - other_at <= 43200000, false) AS other_on, coalesce(at_ms - self_at <= 43200000, false) AS self_on
                           FROM (SELECT e.user_id, e.pos, e.at_ms, e.id, e.kind, CASE WHEN anew THEN NULL ELSE self_at END AS self_at, CASE WHEN anew THEN NULL ELSE other_at END AS other_at, CASE WHEN anew THEN NULL ELSE self_began END AS self_began, CASE WHEN anew THEN NULL ELSE other_began END AS other_began,
                                        CASE WHEN anew THEN 0 ELSE run END AS run, CASE WHEN anew THEN 0 ELSE n END AS n, CASE WHEN anew THEN 0 ELSE since END AS since, NOT anew AND due AS due, NOT anew AND telling AS telling
                                 FROM (SELECT s.* EXCLUDE (at_ms, id, kind, action, pos), e.*, coalesce(e.at_ms - s.at_ms > 144000000, false) AS anew FROM s JOIN e ON e.user_id = s.user_id AND e.pos = s.pos + 1) e))))),
       spoken AS (SELECT user_id, greatest(coalesce(other_at + 14400000, 0), coalesce(self_at + 28800000, 0)) + 1 AS silence, lead(at_ms) OVER (PARTITION BY user_id ORDER BY pos) AS next_at FROM s WHERE kind <> 'tool')
       SELECT user_id, at_ms AS "at", id, action FROM s WHERE pos > 0 UNION ALL SELECT user_id, silence, NULL, 'generate_message' FROM spoken, until WHERE silence < coalesce(next_at, until)""",
)
def turn_taking(t: Tables) -> DataFrame:
    """What a party would do at each event and in silences, from a stream up to its watermark."""
    kind = F.when(F.col("event_type") == "click", "self").when(F.col("event_type") == "purchase", "backchannel").when(F.col("event_type") == "error", "tool").otherwise("other")
    out = workspace(t.spark, "turns")
    with settings(t.spark, spark__sql__streaming__stateStore__providerClass=turns.STATE_STORE):
        stateful.run_once(turns.stream_turn_taking(_event_stream(t).withColumn("kind", kind), TURN_POLICY, "user_id", "ts", "event_id", "kind", "1 hour"), f"{out}/rows", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/rows")


@query("stream_correlated", "SELECT user_id, min(ts) FILTER (event_type = 'view') IS NOT NULL AS viewed, min(ts) FILTER (event_type = 'click') IS NOT NULL AS clicked FROM events GROUP BY 1")
def stream_correlated(t: Tables) -> DataFrame:
    """Times of several kinds of events by item, in one aggregation."""
    found = stateful.correlate(t.events, "user_id", "event_type", "ts", ["view", "click"])
    return found.select("user_id", F.col("view").isNotNull().alias("viewed"), F.col("click").isNotNull().alias("clicked"))


@query(
    "stream_joined",
    """WITH e AS (SELECT user_id, event_type, ts FROM events)
       SELECT v.user_id, epoch_us(v.ts) AS viewed, epoch_us(c.ts) AS clicked, epoch_us(p.ts) AS purchased FROM e v LEFT JOIN e c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 24 HOUR
       LEFT JOIN e p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 24 HOUR WHERE v.event_type = 'view' AND v.ts < (SELECT max(ts) FROM e) - INTERVAL 96 HOUR""",
)
def stream_joined(t: Tables) -> DataFrame:
    """Views with the clicks and purchases that follow within a day, from three streams (M20): those whose day was over when the stream stopped."""
    out = workspace(t.spark, "joined")
    found = stateful.correlate_streams(_event_stream(t), "user_id", "event_type", "ts", ["view", "click", "purchase"], "24 HOURS", "1 hour")
    stateful.run_once(found, f"{out}/rows", f"{out}/checkpoint")
    last = t.events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 96 HOURS")).alias("until"))
    rows = t.spark.read.parquet(f"{out}/rows").join(F.broadcast(last), F.col("view") < F.col("until"))  # one row
    return rows.select("user_id", *(F.unix_micros(k).alias(name) for k, name in (("view", "viewed"), ("click", "clicked"), ("purchase", "purchased"))))


@query("model_means", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def model_means(t: Tables) -> DataFrame:
    """Means of a few models."""
    return analytics.mean_error_count(t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", F.round("mean", 4).alias("mean"))
