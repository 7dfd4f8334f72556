"""Further operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import masking, text
from sparkloom.operators import analytics, reconcile, retrieval, scoring, ticks
from sparkloom.plans.catalog import Tables, query
from sparkloom.plans.window_queries import TICKS, tick_table


@query(
    "score_summary",
    """WITH s AS (SELECT o_custkey % 5 AS g, o_orderkey AS sim, o_orderkey % 7 AS c, 7 AS t, o_orderpriority AS lang, (o_orderkey % 7) / 7.0 AS s FROM orders)
       SELECT g, round(avg(s), 6) AS mean_score, count(*) FILTER (s = 1) AS perfect, count(*) FILTER (s < 1) AS drifted, round(sum(c) / sum(t), 6) AS turn_accuracy,
       (SELECT list(lang ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM s d WHERE d.g = s.g AND d.s < 1 GROUP BY 1 ORDER BY n DESC, lang LIMIT 3)) AS drift_languages,
       (SELECT list(sim ORDER BY v, sim) FROM (SELECT sim, d.s AS v FROM s d WHERE d.g = s.g ORDER BY d.s, sim LIMIT 3)) AS worst FROM s GROUP BY g""",
)
def score_summary(t: Tables) -> DataFrame:
    """Scores of a run at a glance."""
    rows = t.orders.select((F.col("o_custkey") % 5).alias("g"), F.col("o_orderkey").alias("sim"), (F.col("o_orderkey") % 7).alias("c"), F.lit(7).alias("t"), F.col("o_orderpriority").alias("lang"))
    out = analytics.score_summary(rows, ["g"], "sim", "c", "t", "lang", 3)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "turn_accuracy")})


@query("domain_percentages", "SELECT r_name, CAST(r_regionkey * 100 AS DOUBLE) AS r_regionkey FROM region")
def domain_percentages(t: Tables) -> DataFrame:
    """Metrics of each domain, once each."""
    return analytics.domain_percentages(t.region.withColumn("r_regionkey", F.col("r_regionkey").cast("double")), "r_name", ["r_regionkey"])


@query("issue_classes", "SELECT CASE WHEN l_discount > 0.08 THEN 'error' WHEN l_linenumber >= 5 THEN 'unresponsive' ELSE 'fine' END AS issue, count(*) AS n, count(*) FILTER (l_linenumber >= 5) AS over_threshold FROM lineitem GROUP BY 1")
def issue_classes(t: Tables) -> DataFrame:
    """What went wrong."""
    return analytics.classify_issues(t.lineitem.withColumn("errors", (F.col("l_discount") > 0.08).cast("int")), [], "l_linenumber", 5, "errors")


@query("both_roles", "SELECT conv_id, max(length(text)) FILTER (role = 'user') AS user_longest, max(length(text)) FILTER (role = 'assistant') AS agent_longest FROM conversations GROUP BY 1")
def both_roles(t: Tables) -> DataFrame:
    """A run's figures for both roles side by side."""
    return analytics.run_pairs(t.conversations.replace("assistant", "agent", "role"), ["conv_id"], "role", {"longest": F.max(F.length("text"))})


@query("last_by_name", "SELECT p_brand, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def last_by_name(t: Tables) -> DataFrame:
    """The last record of each name."""
    return analytics.last_by_name(t.part.select("p_brand", "p_name", "p_partkey"), "p_brand", "p_partkey")


@query(
    "all_checks",
    """SELECT 'all' AS name, bool_and(o_orderkey >= 0) AS keys, bool_and(o_orderstatus IN ('F', 'O', 'P')) AS second, bool_and(o_orderkey >= 0) AND bool_and(o_orderstatus IN ('F', 'O', 'P')) AS valid FROM orders
       UNION ALL SELECT 'done', bool_and(o_orderkey >= 0), bool_and(o_orderstatus = 'F'), bool_and(o_orderkey >= 0) AND bool_and(o_orderstatus = 'F') FROM orders""",
)
def all_checks(t: Tables) -> DataFrame:
    """Checks that must hold for all rows: two that do, and two of which one doesn't."""
    keys = F.col("o_orderkey") >= 0
    good = analytics.all_checks(t.orders, {"keys": keys, "second": F.col("o_orderstatus").isin("F", "O", "P")}).withColumn("name", F.lit("all"))
    return good.unionByName(analytics.all_checks(t.orders, {"keys": keys, "second": F.col("o_orderstatus") == "F"}).withColumn("name", F.lit("done")))


@query("changed_tags", "SELECT event_type AS old, CASE WHEN event_type = 'view' THEN 'seen' ELSE 'other' END AS new, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL")
def changed_tags(t: Tables) -> DataFrame:
    """How often each tag was rewritten."""
    rows = t.events.select("event_id", F.array("event_type").alias("old_tags"))
    rows = rows.withColumn("new_tags", F.transform("old_tags", lambda x: F.when(x == "view", "seen").when(x == "click", "click").otherwise("other")))
    return analytics.changed_tags(rows, "event_id", "old_tags", "new_tags")


@query("stitched_sections", "SELECT conv_id, sha256(string_agg(CASE WHEN turn % 3 = 1 THEN 'override' ELSE t END, chr(10) ORDER BY turn)) AS sha FROM (SELECT conv_id, turn, max(text) AS t FROM conversations GROUP BY ALL) GROUP BY 1")
def stitched_sections(t: Tables) -> DataFrame:
    """Documents put together from overridden sections."""
    source = t.conversations.groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    override = source.where("turn % 3 = 1").withColumn("text", F.lit("override"))
    return analytics.stitched_sections(source, override, "conv_id", "turn", "text").select("conv_id", F.sha2("text", 256).alias("sha"))


@query("grouped_units", "SELECT CAST(n_regionkey AS VARCHAR) AS unit, list(n_name ORDER BY n_name) AS tools FROM nation WHERE n_regionkey < 2 GROUP BY 1 UNION ALL SELECT n_name, [n_name] FROM nation WHERE n_regionkey >= 2")
def grouped_units(t: Tables) -> DataFrame:
    """Tools by group, and those in none."""
    tools = t.nation.select("n_name")
    groups = t.nation.where("n_regionkey < 2").select("n_name", F.col("n_regionkey").cast("string").alias("g"))
    return analytics.grouped_units(tools, groups, "n_name", "g")


@query("fan_out", "SELECT c_custkey, upper(c_mktsegment) || '!' AS result FROM customer")
def fan_out(t: Tables) -> DataFrame:
    """Each distinct text processed once, results handed back to all."""
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("content"))
    out = analytics.fan_out(rows, F.sha2("content", 256), None, lambda d: d.select("__key", F.concat(F.upper("content"), F.lit("!")).alias("result")))
    return out.select("c_custkey", "result")


@query("literal_map", "SELECT p_brand, arg_max(p_type, p_partkey) AS p_type FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY 1")
def literal_map(t: Tables) -> DataFrame:
    """Canonical to localised literals."""
    return analytics.literal_map(t.part, "p_brand", "p_type", "p_partkey")


@query("distinct_models", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_models(t: Tables) -> DataFrame:
    return reconcile.distinct_values(t.customer, "c_mktsegment")


@query("unfinished_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def unfinished_rows(t: Tables) -> DataFrame:
    """Rows without a final text."""
    return reconcile.unfinished(t.orders.withColumn("final", F.when(F.col("o_orderstatus") == "P", " ").otherwise("x")), "final").select("o_orderkey")


@query("group_fingerprints", "SELECT count(*) AS groups, count(DISTINCT rows) AS kinds FROM (SELECT o_custkey, string_agg(o_orderstatus || o_orderpriority, ',' ORDER BY o_orderstatus || o_orderpriority) AS rows FROM orders GROUP BY 1)")
def group_fingerprints(t: Tables) -> DataFrame:
    """Customers whose orders are of the same kinds, by hashes that don't depend on the order of rows."""
    found = reconcile.fingerprints(t.orders.repartition(5), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return found.agg(F.count(F.lit(1)).alias("groups"), F.count_distinct("fingerprint").alias("kinds"))


@query(
    "required_documents",
    """WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), a AS (SELECT CASE WHEN doc_id % 2 = 0 THEN title ELSE CAST(doc_id AS VARCHAR) END AS wanted FROM d UNION ALL SELECT 'none')
       SELECT wanted, coalesce(b.id, d.doc_id) AS found FROM a LEFT JOIN (SELECT title, min(doc_id) AS id FROM d GROUP BY 1) b ON wanted = b.title LEFT JOIN d ON wanted = CAST(d.doc_id AS VARCHAR)""",
)
def required_documents(t: Tables) -> DataFrame:
    """Half of all documents asked for by their first line, half by id (Q18)."""
    docs = t.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    asked = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.col("doc_id").cast("string")).alias("wanted")).union(t.spark.sql("SELECT 'none'"))
    return retrieval.required_documents(asked, docs, "wanted", "doc_id", "title").select("wanted", "found")


@query("cache_figures", "SELECT label, count(*) AS entries, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings GROUP BY 1")
def cache_figures(t: Tables) -> DataFrame:
    """Entries and sizes by embedder."""
    return retrieval.cache_figures(t.embeddings, "label", "embedding")


@query("path_functions", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS region, n_regionkey = 1 AS wanted, n_name AS called FROM nation")
def path_functions(t: Tables) -> DataFrame:
    """Parts of paths, wanted leaves, printed calls."""
    path = F.concat(F.lit("data/regions/"), "n_regionkey", F.lit("/0/"), F.when(F.col("n_regionkey") == 1, "title").otherwise("id"))
    call = F.concat(F.lit("get_nation(name='"), "n_name", F.lit("', k="), "n_nationkey", F.lit(")"))
    return t.nation.select("n_nationkey", text.path_segment(path, "regions").alias("region"), text.path_wanted(path, ["title"]).alias("wanted"), F.try_element_at(text.printed_call(call)["args"], F.lit("name")).alias("called"))


@query("counted_turns", "SELECT conv_id, turn, role, NOT (role = 'assistant' AND turn = min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id)) AS counts FROM conversations")
def counted_turns(t: Tables) -> DataFrame:
    """Turns without the agent's fixed greeting."""
    from sparkloom.operators import windows

    rows = windows.first_flag(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], F.col("role") == "assistant")
    return rows.select("conv_id", "turn", "role", (~text.skips_first_agent_turn(F.lit("l2_interaction"), "role", "is_first")).alias("counts"))


@query("unique_sheet_names", "SELECT n_nationkey, CASE WHEN row_number() OVER (PARTITION BY left(n_name, 5) ORDER BY n_nationkey) > 1 THEN left(n_name, 5) || '_' || row_number() OVER (PARTITION BY left(n_name, 5) ORDER BY n_nationkey) ELSE left(n_name, 5) END AS name FROM nation")
def unique_sheet_names(t: Tables) -> DataFrame:
    """Names cut short, repeated ones numbered."""
    return t.nation.select("n_nationkey", text.unique_names("n_name", [], [F.col("n_nationkey")], 9).alias("name"))


@query("json_values_set", "SELECT event_id, event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS other FROM events")
def json_values_set(t: Tables) -> DataFrame:
    """Values set at paths of JSON, those at other paths staying."""
    nested = F.concat(F.lit('{"a": '), "props", F.lit(', "k": 0}'))
    new = masking.set_json_values(nested, F.array(F.lit("k"), F.lit("none/x")), F.array(F.col("event_id").cast("string"), F.lit("1")))
    return t.events.select("event_id", text.json_path(new, "$.k", "bigint").alias("k"), text.json_path(new, "$.a.k", "bigint").alias("other"))


@query(
    "merged_utterances",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, max(text) AS text, [turn // 2, (turn + 1) // 2] AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations GROUP BY conv_id, turn),
       r AS (SELECT conv_id, turn, text, n, 1 AS message, ids AS seen FROM c WHERE n = 1
             UNION ALL SELECT c.conv_id, c.turn, c.text, c.n, CASE WHEN list_has_any(c.ids, r.seen) THEN r.message ELSE r.message + 1 END, CASE WHEN list_has_any(c.ids, r.seen) THEN list_concat(r.seen, c.ids) ELSE c.ids END FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
       SELECT conv_id, min(turn) AS first, max(turn) AS last, CAST(sum(coalesce(length(text), 0)) AS INTEGER) AS characters FROM r GROUP BY conv_id, message""",
)
def merged_utterances(t: Tables) -> DataFrame:
    """Chunks joined while their utterance ids overlap those gathered."""
    rows = t.conversations.groupBy("conv_id", "turn").agg(F.max("text").alias("text")).withColumn("ids", F.array((F.col("turn") / 2).cast("int"), ((F.col("turn") + 1) / 2).cast("int")))
    return scoring.merged_utterances(rows, "conv_id", "turn", "ids", "text").select("conv_id", "first", "last", F.length("content").alias("characters"))


@query("rescored_runs", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 0.5 ELSE 0.0 END::DOUBLE AS reward FROM orders")
def rescored_runs(t: Tables) -> DataFrame:
    """A run's rewards by another basis: a product of its components, 0 for a run cut short."""
    parts = F.create_map(F.lit("DB"), (F.col("o_orderstatus") == "F").cast("double"), F.lit("TALK"), F.when(F.col("o_totalprice") > 150_000, 0.5).otherwise(0.0), F.lit("X"), F.lit(0.0))
    sims = t.orders.select(F.col("o_orderkey").alias("id"), parts.alias("parts"), F.when(F.col("o_orderpriority") == "5-LOW", "max_steps").otherwise("user_stop").alias("end"))
    return scoring.rescored(sims, F.array(F.lit("DB"), F.lit("TALK"), F.lit("absent")), "parts", "end").select("id", "reward")


@query("assertions_met", "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END = (o_totalprice > 150000), false) AS met FROM orders")
def assertions_met(t: Tables) -> DataFrame:
    """Checks that returned what was asserted, true or false; one that returned nothing never did."""
    returned = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return t.orders.select("o_orderkey", scoring.assertion_met(returned, F.col("o_totalprice") > 150_000).alias("met"))


@query(
    "call_segments",
    """WITH t AS (SELECT user_id AS conv_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events),
       r AS (SELECT conv_id, event_id - 1 AS id, min(tick) AS e FROM t WHERE event_type <> 'click' GROUP BY ALL)
       SELECT t.conv_id, t.event_id AS id, CAST(t.tick AS INTEGER) AS start, CAST(r.e AS INTEGER) AS "end" FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.event_id = r.id WHERE t.event_type IN ('click', 'view')""",
)
def call_segments(t: Tables) -> DataFrame:
    """Calls from the tick they are made in to that of their result."""
    rows = tick_table(t).select("conv_id", "tick", F.trim("own").cast("long").alias("call"), (F.trim("other").cast("long") - 1).alias("result"))
    return ticks.call_segments(rows, ["conv_id"], "tick", "call", "result")


@query(
    "reaction_chances",
    """WITH g AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 3600000000 AS tick FROM events)
       SELECT event_id, tick, CASE WHEN tick < 3 THEN 0.0 WHEN tick >= 8 THEN 1.0 ELSE round(1 - exp(-0.5 * 0.2), 6) END::DOUBLE AS chance, greatest(0.0, least(1.0, round((tick - 2) / 5, 6)))::DOUBLE AS ramp FROM g WHERE tick IS NOT NULL""",
)
def reaction_chances(t: Tables) -> DataFrame:
    """Chances to react by how many hours a user's events are apart."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 3_600_000_000)
    rows = t.events.select("event_id", gap.alias("tick")).where("tick IS NOT NULL")
    return rows.select("event_id", "tick", F.round(ticks.reaction_chance("tick", 3, 8, 0.5, 0.2), 6).alias("chance"), F.round(ticks.ramp_chance("tick", 2, 7), 6).alias("ramp"))


@query(
    "lossy_ticks",
    f"""WITH t AS (SELECT conv_id, tick, CAST('0x' || left(md5(conv_id || '|' || tick || '|0'), 13) AS BIGINT) / 4503599627370496.0 AS u FROM {TICKS})
       SELECT conv_id, tick, coalesce(last_value(CASE WHEN u < 0.05 THEN true WHEN u >= 0.7 THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY tick ROWS UNBOUNDED PRECEDING), false) AS lost FROM t""",
)
def lossy_ticks(t: Tables) -> DataFrame:
    """Ticks lost in bursts."""
    return ticks.lossy_ticks(tick_table(t).select("conv_id", "tick"), "conv_id", "tick", 0.05, 0.3)


@query("due_events", "WITH t AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events) SELECT conv_id, CAST(tick AS INTEGER) AS tick, 'noise' AS event FROM t WHERE tick = conv_id % 7 + 1")
def due_events(t: Tables) -> DataFrame:
    """Events at the first tick that is due."""
    rows = tick_table(t).select("conv_id", "tick")
    schedule = rows.select("conv_id").distinct().withColumn("at", F.col("conv_id") % 7 + 0.5).withColumn("event", F.lit("noise"))
    return ticks.due_events(rows, schedule, "conv_id", "tick", "at").select("conv_id", "tick", "event")


@query(
    "proportional_transcript",
    """WITH w AS (SELECT conv_id, CAST(turn AS BIGINT) // 2 AS pair, turn * 3 + turn // 2 * 2 AS s, text FROM conversations),
       u AS (SELECT conv_id, min(s) AS s, max(s) + 2 AS e, string_agg(text, ' ' ORDER BY s, text) AS text FROM w GROUP BY conv_id, pair),
       k AS (SELECT *, unnest(range(s, e + 1)) AS tick FROM u),
       p AS (SELECT *, CAST(ceil((tick - s) / (e - s + 1) * length(text)) AS BIGINT) AS t1, CAST(ceil((tick - s + 1) / (e - s + 1) * length(text)) AS BIGINT) AS t2 FROM k)
       SELECT conv_id, CAST(tick AS BIGINT) AS tick, substr(text, t1 + 1, t2 - t1) AS piece FROM p""",
)
def proportional_transcript(t: Tables) -> DataFrame:
    """All turns of conversations, three ticks each with a pause after every second, dealt out over the ticks."""
    at = F.col("turn").cast("long") * 3 + F.floor(F.col("turn") / 2) * 2
    words = t.conversations.select("conv_id", at.alias("s"), (at + 2).alias("e"), "text")
    grid = words.groupBy("conv_id").agg(F.max("e").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 2)).alias("tick"))
    return ticks.proportional_transcript(grid, words, ["conv_id"], "tick", "s", "e", "text", 1).select("conv_id", "tick", "piece")
