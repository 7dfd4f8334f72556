"""Predicates, small functions, registries and frames that the other catalogues don't reach, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import registry, stats, text
from sparkloom.operators import analytics, dml, joins, lookups, metrics, reconcile, retrieval, sampling, scoring, topk, windows
from sparkloom.plans import predicates
from sparkloom.plans.catalog import Tables, query

_OK = "o_orderstatus = 'F'"


@query("failed_runs", f"SELECT o_orderkey FROM orders WHERE NOT ({_OK})")
def failed_runs(t: Tables) -> DataFrame:
    """Simulations without full reward."""
    return metrics.failed_only(t.orders.withColumn("reward", (F.col("o_orderstatus") == "F").cast("double")), "reward").select("o_orderkey")


@query("never_solved", f"SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_OK})")
def never_solved(t: Tables) -> DataFrame:
    """Tasks that no trial solved, with all their trials."""
    return metrics.never_solved(t.orders.withColumn("reward", (F.col("o_orderstatus") == "F").cast("double")), "o_custkey", "reward").select("o_custkey", "o_orderkey")


@query("pass_hat_with_task", f"SELECT o_custkey, min(o_orderpriority) AS info, round(count(*) FILTER ({_OK}) / count(*), 6) AS pass_hat_1 FROM orders GROUP BY 1")
def pass_hat_with_task(t: Tables) -> DataFrame:
    """pass^k of each task with what is known of the task, in one aggregation."""
    trials = metrics.trials_by_task(t.orders, "o_custkey", F.col("o_orderstatus") == "F", [F.min("o_orderpriority").alias("info")])
    return metrics.pass_hat_by_task(trials, [1]).select("o_custkey", "info", F.round("pass_hat_1", 6).alias("pass_hat_1"))


@query(
    "pass_hat_by_model",
    f"""WITH n AS (SELECT c_mktsegment, o_orderpriority, o_custkey, count(*) AS n, count(*) FILTER ({_OK}) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       SELECT c_mktsegment, o_orderpriority, round(avg(c / n), 6) AS pass_hat_1, round(avg(CASE WHEN n >= 2 THEN c * (c - 1) / (n * (n - 1)) END), 6) AS pass_hat_2 FROM n GROUP BY ALL""",
)
def pass_hat_by_model(t: Tables) -> DataFrame:
    """pass^k of each model and mode."""
    rows = joins.lookup(t.orders.withColumn("c_custkey", F.col("o_custkey")), t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"])
    trials = rows.groupBy("c_mktsegment", "o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return metrics.mean_pass_hat(trials, [1, 2], ["c_mktsegment", "o_orderpriority"]).withColumns({c: F.round(c, 6) for c in ("pass_hat_1", "pass_hat_2")})


@query("pass_hat_by_actions", f"WITH l AS (SELECT l_orderkey, count(*) AS actions FROM lineitem GROUP BY 1) SELECT CAST(b AS BIGINT) AS actions, round(coalesce(avg(CAST({_OK} AS DOUBLE)), 0), 6) AS mean FROM range(0, 10) r(b) LEFT JOIN (l JOIN orders ON o_orderkey = l_orderkey) ON actions = b GROUP BY 1")
def pass_hat_by_actions(t: Tables) -> DataFrame:
    """Mean success by number of actions over all models, 0 where a bucket is empty."""
    counted = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("actions"))
    rows = t.orders.join(counted, "o_orderkey").withColumn("ok", (F.col("o_orderstatus") == "F").cast("double"))
    spine = t.spark.range(10).select(F.col("id").alias("actions"))
    return analytics.by_bucket(rows, "actions", "ok", spine).select("actions", F.round("mean", 6).alias("mean"))


@query(
    "shares_of_group",
    f"""WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(*) FILTER ({_OK}) AS relevant FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       SELECT *, round(relevant / nullif(sum(relevant) OVER w, 0), 6) AS share_of_relevant, round(n / sum(n) OVER w, 6) AS share_of_all FROM c WINDOW w AS (PARTITION BY c_mktsegment)""",
)
def shares_of_group(t: Tables) -> DataFrame:
    """Counts beside the relevant and all rows of their group."""
    rows = joins.lookup(t.orders.withColumn("c_custkey", F.col("o_custkey")), t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return analytics.shares_of(rows, ["o_orderpriority"], ["c_mktsegment"], F.col("o_orderstatus") == "F").withColumns({c: F.round(c, 6) for c in ("share_of_relevant", "share_of_all")})


@query(
    "persona_against_solo",
    """WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS solo_mean FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
       SELECT c_nationkey, c_custkey % 3 AS persona, round(avg(c_acctbal), 4) AS mean, round(any_value(solo_mean), 4) AS solo_mean FROM customer LEFT JOIN s USING (c_nationkey) WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL""",
)
def persona_against_solo(t: Tables) -> DataFrame:
    """Each persona's mean beside the solo mode's."""
    out = analytics.against_mode(t.customer.withColumn("persona", F.col("c_custkey") % 3), ["c_nationkey"], "persona", "c_mktsegment", "BUILDING", "c_acctbal")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "solo_mean")})


@query(
    "language_correctness",
    """WITH d AS (SELECT conv_id, turn, role, text, CASE WHEN text IS NULL OR trim(text) = '' OR length(text) % 5 = 0 THEN NULL WHEN contains(text, 'e') THEN 'en' ELSE 'th' END AS found, CASE WHEN role = 'user' THEN 'th' ELSE 'en' END AS expected FROM conversations WHERE role IN ('user', 'assistant')),
       s AS (SELECT * FROM d WHERE text IS NOT NULL AND trim(text) <> '')
       SELECT k.conv_id, k.role, count(s.turn) AS turns, count(s.found) AS detected, count(*) FILTER (s.found = s.expected) AS correct, list_sort(coalesce(list(s.turn) FILTER (s.turn IS NOT NULL AND s.found IS DISTINCT FROM s.expected), [])) AS incorrect, round_even(count(*) FILTER (s.found = s.expected) / nullif(count(s.turn), 0), 4) AS score
       FROM (SELECT DISTINCT conv_id, role FROM d) k LEFT JOIN s ON k.conv_id = s.conv_id AND k.role = s.role GROUP BY ALL""",
)
def language_correctness(t: Tables) -> DataFrame:
    """Shares of turns in the language their role should speak (V17, V19, X11); an undetected turn is incorrect."""
    found = F.when(text.is_blank("text") | (F.length("text") % 5 == 0), None).when(F.contains("text", F.lit("e")), "en").otherwise("th")
    turns = t.conversations.where(F.col("role").isin("user", "assistant")).withColumn("found", found)
    return analytics.language_correctness(turns, ["conv_id", "role"], "turn", "text", "found", text.expected_language("role", ["user"], F.lit("th")))


@query("records_by_field", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def records_by_field(t: Tables) -> DataFrame:
    """All records whose field has a value."""
    people = lookups.by_field(t.customer, "c_mktsegment", "BUILDING").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return lookups.by_field(t.orders, "o_custkey", 7).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).union(people)


@query("every_record", "SELECT s_suppkey, s_name FROM supplier")
def every_record(t: Tables) -> DataFrame:
    """A whole table."""
    return lookups.every_record(t.supplier, "s_suppkey").select("s_suppkey", "s_name")


@query("normal_keys", "SELECT n_nationkey, lower(trim(n_name)) AS n_name FROM nation")
def normal_keys(t: Tables) -> DataFrame:
    """A key made normal where a frame has it, nothing where not."""
    return text.with_normal(text.with_normal(t.nation.select("n_nationkey", F.concat(F.lit(" "), "n_name").alias("n_name")), "n_name"), "no_such_column")


@query("tick_replay", "WITH e AS (SELECT user_id AS conv_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT conv_id, '{\"last\": \"' || arg_max(event_type, n) || '\", \"n\": ' || printf('%.1f', count(*) * 2.0) || '}' AS state FROM e GROUP BY 1")
def tick_replay(t: Tables) -> DataFrame:
    """Calls in ticks of two sides replayed as mutations (V32): one side counts up, the other sets."""
    tick = F.row_number().over(Window.partitionBy("conv_id").orderBy("ts", "event_id")).alias("tick")
    call = lambda name, arguments: F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))
    rows = t.events.select(F.col("user_id").alias("conv_id"), "ts", "event_id", "event_type").select("conv_id", tick, "event_type")
    ticks = rows.select("conv_id", "tick", F.struct(F.array(call("add:n", F.lit("1")), call("add:n", F.lit("1"))).alias("tool_calls")).alias("own"), F.struct(F.array(call("set:last", F.col("event_type"))).alias("tool_calls")).alias("other"))
    calls = scoring.tick_calls(ticks, "conv_id", "tick", ["own", "other"])
    calls = calls.select("conv_id", "n", F.substring_index("name", ":", 1).alias("op"), F.substring_index("name", ":", -1).alias("key"), F.col("arguments").alias("value"))
    return scoring.replay_states(calls, "conv_id", "n", "op", "key", "value").select("conv_id", "state")


@query(
    "tool_responses",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * 2 AS VARCHAR) WHEN n_nationkey % 3 = 1 THEN '\"Error: no tool hidden_one\"' ELSE '\"Error: too odd\"' END AS response, n_nationkey % 3 <> 0 AS error FROM nation",
)
def tool_responses(t: Tables) -> DataFrame:
    """Calls answered by a catalogue's tools; what a tool raises is its response."""
    tools = registry.ToolCatalog()

    @tools.tool("read")
    def double(x):
        return x * 2

    @tools.tool("write")
    def refuse(x):
        raise ValueError("too odd")

    @tools.tool("read", hidden=True)
    def hidden_one(x):
        return x

    name = F.when(F.col("n_nationkey") % 3 == 0, "double").when(F.col("n_nationkey") % 3 == 1, "hidden_one").otherwise("refuse")
    calls = t.nation.select("n_nationkey", name.alias("tool"), F.to_json(F.struct(F.col("n_nationkey").alias("x"))).alias("arguments"))
    return registry.respond(calls, tools, "tool", "arguments").select("n_nationkey", "response", "error")


@query(
    "tool_catalog",
    """SELECT name, kind, mutates, count(*) AS calls, CAST(sum(CASE name WHEN 'view' THEN 2 * event_id WHEN 'click' THEN -event_id ELSE event_id END) AS BIGINT) AS answers
       FROM events JOIN (VALUES ('view', 'read', false), ('click', 'write', true), ('error', 'generic', false), ('purchase', 'write', true)) v(name, kind, mutates) ON event_type = name GROUP BY ALL""",
)
def tool_catalog(t: Tables) -> DataFrame:
    """Events as calls of tools from SQL, by what the tools do; a hidden tool isn't listed before it is unlocked."""
    tools = registry.ToolCatalog()
    kinds = {"view": ("read", lambda x: 2 * x), "click": ("write", lambda x: -x), "error": ("generic", lambda x: x), "purchase": ("write", lambda x: x), "signup": ("think", lambda x: x)}
    for name, (kind, fn) in kinds.items():
        fn.__name__ = name
        tools.tool(kind, "long", hidden=name in ("error", "signup"))(fn)
    tools.unlock("error")
    tools.register_sql(t.spark)
    if tools.writes() != ["click", "purchase"]:
        raise AssertionError("the catalogue doesn't do what it lists")
    answer = F.coalesce(*(F.when(F.col("event_type") == x.name, F.call_function(x.name, F.col("event_id"))) for x in tools.listed()))
    calls = t.events.select(F.col("event_type").alias("name"), answer.alias("answer"))
    listed = tools.frame(t.spark).select("name", "kind", "mutates")  # a row for each tool
    return calls.join(F.broadcast(listed), "name").groupBy("name", "kind", "mutates").agg(F.count(F.lit(1)).alias("calls"), F.sum("answer").alias("answers"))


@query("query_vectors", "SELECT conv_id, turn, role, [CAST(length(text) AS DOUBLE), 1.0::DOUBLE] AS v FROM conversations WHERE trim(text) <> ''")
def query_vectors(t: Tables) -> DataFrame:
    """Turns as queries, each text encoded once however often it is asked."""
    asked = t.conversations.where(F.trim("text") != "").select("conv_id", "turn", "role", "text")
    found = registry.encoded(asked, "text", lambda texts: [[float(len(x)), 1.0] for x in texts], "v")
    return found.select("conv_id", "turn", "role", F.col("v").cast("array<double>").alias("v"))


@query("deep_merge", "SELECT n_nationkey, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'b' END AS b, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 1 END AS x, 2 AS y, n_nationkey % 2 = 0 AS z FROM nation")
def deep_merge(t: Tables) -> DataFrame:
    """Records merged at any depth: records within records, maps within them."""
    inner = lambda b, m: F.struct(b.alias("b"), m.alias("m"))
    old = t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("a"), inner(F.lit("b"), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))).alias("n")).alias("r"))
    new = t.nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.struct(F.lit(None).cast("string").alias("a"), inner(F.lit("new"), F.create_map(F.lit("x"), F.lit(7), F.lit("z"), F.lit(9))).alias("n")).alias("r"))
    out = dml.merge_records(old, new, "n_nationkey")
    at = lambda k: F.try_element_at("r.n.m", F.lit(k))
    return out.select("n_nationkey", "r.a", "r.n.b", at("x").alias("x"), at("y").alias("y"), at("z").isNotNull().alias("z"))


@query("constraint_texts_of_booleans", f"SELECT o_orderkey FROM orders WHERE {_OK}")
def constraint_texts_of_booleans(t: Tables) -> DataFrame:
    """Booleans compare as Python writes them."""
    return predicates.query(t.orders.withColumn("done", F.col("o_orderstatus") == "F"), {"done__startswith": "Tr"}).select("o_orderkey")


@query("constraint_ids_with_records", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 3")
def constraint_ids_with_records(t: Tables) -> DataFrame:
    """Ids with their records."""
    return predicates.query(t.orders, {"o_custkey": 3}, "o_orderkey", return_ids=True).select("o_orderkey", "record.o_totalprice")


@query("catalog_tables", "SELECT 'inventory_region' AS name, (SELECT count(*) FROM region) AS rows, true AS unknown_is_none")
def catalog_tables(t: Tables) -> DataFrame:
    """Tables listed and read by name; an unknown name is None."""
    t.region.createOrReplaceTempView("inventory_region")
    name = next(x for x in predicates.list_tables(t.spark) if x == "inventory_region")
    unknown = predicates.table_or_none(t.spark, "inventory_nothing") is None
    return predicates.table_or_none(t.spark, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(unknown).alias("unknown_is_none"))


@query("batches", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders")
def batches(t: Tables) -> DataFrame:
    """Batches of a fixed size within a group (P20)."""
    return sampling.every_nth_batch(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@query("ranked_rows", "SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer")
def ranked_rows(t: Tables) -> DataFrame:
    """The place of each row of a group, ties by id."""
    return topk.top_by_score(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", ["c_custkey"], 1 << 40).select("c_mktsegment", "c_custkey", "rank")


@query(
    "small_functions",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS named, o_orderstatus = 'F' AS flag, len(string_split(o_orderpriority, '-')) AS parts, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, o_orderkey / 32000.0 AS seconds,
       split_part(o_orderpriority, '-', 1) AS file, split_part(o_orderpriority, '-', 2) AS body, CASE WHEN o_orderkey % 4 <> 0 THEN 'a b' END AS line, round(pow(10, -(o_orderkey % 40) / 20.0), 9) AS scale, round(1 - exp(-0.1 * (o_orderkey % 7)), 9) AS chance, '{"value":"' || o_orderstatus || '"}' AS response FROM orders""",
)
def small_functions(t: Tables) -> DataFrame:
    """Scalar functions on names, flags, times and sound."""
    k, address = F.col("o_orderkey"), text.split_address("o_orderpriority", "-")
    return t.orders.select(
        "o_orderkey", text.or_raw(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(F.lit(" ")), "o_orderstatus").alias("named"), text.flag_is(F.col("o_orderstatus") == "F").alias("flag"), text.part_count("o_orderpriority", "-").cast("long").alias("parts"),
        text.time_text("o_orderdate").alias("stamp"), text.audio_seconds(k, 16000).alias("seconds"), address["file"].alias("file"), address["body"].alias("body"), text.one_line(text.first_present(F.when(k % 4 != 0, F.lit("a\nb")), F.lit(" "))).alias("line"),
        F.round(stats.decibels_to_scale(k % 40), 9).alias("scale"), F.round(stats.event_probability(F.lit(0.1), k % 7), 9).alias("chance"), text.response_text("o_orderstatus").alias("response"),
    )


@query("raised_or_found", "SELECT n_nationkey, regexp_extract(n_name, '([0-9]+|[A-Z]+)', 1) AS part, CAST(n_nationkey AS VARCHAR) AS inner_json, 'nation ' || n_name || ' of ' || n_regionkey AS said FROM nation")
def raised_or_found(t: Tables) -> DataFrame:
    """Groups of patterns, JSON in fences, templates."""
    fenced = text.from_fence(F.concat(F.lit("so\n```json\n{\"k\": "), "n_nationkey", F.lit("}\n```")))
    said = F.concat(F.lit("nation "), "n_name", F.lit(" of "), "n_regionkey")
    pattern = text.template_pattern("nation {name} of {region}")
    return t.nation.select(
        "n_nationkey", text.group_or_raise("n_name", "([0-9]+|[A-Z]+)").alias("part"), F.try_variant_get(fenced, "$.k", "string").alias("inner_json"),
        F.concat(F.lit("nation "), F.regexp_extract(said, pattern, 1), F.lit(" of "), F.regexp_extract(said, pattern, 2)).alias("said"),
    )


@query("group_figures", "SELECT l_returnflag, round(avg(l_discount), 3) AS mean, round(sqrt(avg(l_discount * l_discount)), 9) AS rms, NULL::DOUBLE AS nothing FROM lineitem GROUP BY 1")
def group_figures(t: Tables) -> DataFrame:
    """Means and roots of mean squares, NULL of nothing."""
    none = F.lit(None).cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(stats.mean_or_null("l_discount").alias("mean"), F.round(stats.root_mean_square("l_discount"), 9).alias("rms"), stats.mean_or_null(none).alias("nothing"))


@query("identifiers_kept", "SELECT o_orderkey, o_orderkey % 4 <> 1 AS kept FROM orders")
def identifiers_kept(t: Tables) -> DataFrame:
    """Whether a translation holds all of its source's identifiers."""
    source = F.concat(F.lit("see ORD-"), "o_orderkey", F.lit(" and CUST-"), "o_custkey")
    target = F.concat(F.lit("siehe CUST-"), "o_custkey", F.lit(" x"), F.when(F.col("o_orderkey") % 4 != 1, F.concat(F.lit(" ORD-"), "o_orderkey")).otherwise(F.lit("")))
    return t.orders.select("o_orderkey", reconcile.identifiers_kept(source, target, r"[A-Z]+-\d+").alias("kept"))


@query("reranked", "SELECT doc_id, CAST(length(text) % 11 AS DOUBLE) AS score FROM documents WHERE length(text) % 7 <> 0 AND length(text) % 11 >= 4 ORDER BY score DESC, doc_id LIMIT 25")
def reranked(t: Tables) -> DataFrame:
    """Documents scored anew by a scorer from a registry; failures and low scores go."""
    scorers = registry.Registry("scorer")

    @scorers.register("by_length")
    def by_length(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.when(F.length("text") % 7 != 0, (F.length("text") % 11).cast("double")))

    return retrieval.rerank(t.documents.select("doc_id", "text"), scorers.get("by_length"), ["doc_id"], 4.0, 25).select("doc_id", "score")


@query(
    "retrieval_pipeline",
    """WITH s AS (SELECT item_id, doc_id, CAST(CASE WHEN doc_id % 5 = item_id % 5 THEN 2 + doc_id % 3 ELSE 1 END AS DOUBLE) AS score FROM benchmark, documents WHERE doc_id IS NOT NULL AND doc_id % 5 = item_id % 5 OR doc_id % 7 = item_id % 7)
       SELECT item_id, doc_id, max(score) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY max(score) DESC, doc_id) AS INTEGER) AS rank FROM s GROUP BY item_id, doc_id QUALIFY rank <= 4""",
)
def retrieval_pipeline(t: Tables) -> DataFrame:
    """Preprocess, two registered retrievers, best of both, top k by argument."""

    def by_remainder(n: int, score):
        def search(docs: DataFrame, queries: DataFrame) -> DataFrame:
            asked = queries.select("item_id", (F.col("item_id") % n).alias("k"))
            return docs.withColumn("k", F.col("doc_id") % n).join(asked, "k").select("item_id", "doc_id", score.alias("score"))

        return search

    for name, fn in (("inventory_five", by_remainder(5, (F.lit(2.0) + F.col("doc_id") % 3).cast("double"))), ("inventory_seven", by_remainder(7, F.lit(1.0)))):
        if name not in registry.retrievers.names():
            registry.retrievers.register(name)(fn)
    pipeline = retrieval.Pipeline(t.documents, "doc_id", {"retrievers": ["inventory_five", "inventory_seven"], "top_k": 9}, [lambda docs: docs.where("doc_id IS NOT NULL").select("doc_id")])
    return pipeline.search(t.benchmark, "item_id", 4).select("item_id", "doc_id", "score", "rank")


@query("corpus_as_markdown", "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY 1")
def corpus_as_markdown(t: Tables) -> DataFrame:
    """A small corpus, here each conversation, as one text (Q19)."""
    rows = t.conversations.select("conv_id", F.struct("turn", "role", "text").alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.to_markdown(rows, "at", "role", "text", ["conv_id"])


@query(
    "on_time_streak",
    """WITH o AS (SELECT o_custkey, o_orderstatus = 'O' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') || o_orderkey DESC) AS n FROM orders), f AS (SELECT * FROM o WHERE n <= 12)
       SELECT o_custkey, coalesce(min(n) FILTER (NOT ok) - 1, count(*)) AS run FROM f GROUP BY 1""",
)
def on_time_streak(t: Tables) -> DataFrame:
    """How many of the latest payments in a row were on time."""
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"))
    rows = t.orders.select("o_custkey", day.alias("day"), F.when(F.col("o_orderstatus") == "O", "ON_TIME").otherwise("LATE").alias("status"))
    return lookups.on_time_streak(rows, "o_custkey", "day", "status")


@query("customer_by_phone", "SELECT c_custkey AS customer_id FROM customer WHERE c_custkey = 8")
def customer_by_phone(t: Tables) -> DataFrame:
    """The first customer whose own or whose lines' number it is."""
    people = t.customer.select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("p"), "c_custkey").alias("phone_number"), F.array(F.concat(F.lit("L"), "c_custkey")).alias("line_ids"))
    lines = t.customer.select(F.concat(F.lit("L"), "c_custkey").alias("line_id"), F.concat(F.lit("q"), F.col("c_custkey") % 100).alias("phone_number"))
    return lookups.by_any_phone(people, lines, "q8", "customer_id").select("customer_id")


@query("cell_or_zero", "SELECT c_mktsegment, c_nationkey, coalesce(arg_min_null(CASE WHEN c_acctbal > 0 THEN c_acctbal END, c_custkey), 0) AS share FROM customer GROUP BY ALL")
def cell_or_zero(t: Tables) -> DataFrame:
    """A cell's first value, 0.0 where it has none."""
    rows = t.customer.withColumn("share", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return analytics.or_zero(rows, ["c_mktsegment", "c_nationkey"], "share", "c_custkey")


@query("asked_ids", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def asked_ids(t: Tables) -> DataFrame:
    """The rows of given ids, all of which must be there."""
    least = t.orders.agg(F.min("o_custkey")).first()[0]
    return sampling.first_ids(t.orders, [least], "o_custkey").select("o_orderkey")


@query("replay_view", "SELECT conv_id, count(*) FILTER (role = 'user' OR trim(text) <> '') AS messages, 0 AS calls FROM conversations GROUP BY 1")
def replay_view(t: Tables) -> DataFrame:
    """Messages for a replay, without agents' calls and without those that then say nothing."""
    call = F.struct(F.lit("f").alias("name"))
    message = F.struct("turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.array(call)).otherwise(F.array().cast("array<struct<name:string>>")).alias("tool_calls"))
    kept = t.conversations.groupBy("conv_id").agg(F.collect_list(message).alias("m")).withColumn("m", scoring.replay_view("m"))
    calls = F.aggregate("m", F.lit(0), lambda a, x: a + F.size(x["tool_calls"]))
    return kept.select("conv_id", F.size("m").cast("long").alias("messages"), calls.alias("calls"))


@query("kept_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def kept_last(t: Tables) -> DataFrame:
    """The last row of each key (W02), new ids inserted once, the first by order."""
    last = windows.keep_last(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")])
    added = dml.insert_if_absent(last.limit(0), t.orders.select("o_custkey", "o_orderkey", (-F.col("o_orderkey")).alias("back")), "o_custkey", "back")[1]
    return last.join(added.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
