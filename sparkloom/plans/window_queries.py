"""Segments, silences, intervals, runs and linear transcripts over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import joins, ticks, windows
from sparkloom.plans.catalog import Tables, query


def _seconds(c: str = "ts") -> Column:
    """Whole seconds since 1970 of a zone-less time, taken as UTC."""
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", _seconds().alias("s"))


_E = "(SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"
_SEGMENTS = f"""b AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 1800 THEN 0 ELSE 1 END AS b FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
     g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id) AS segment FROM b)"""


@query("session_segments", f'WITH {_SEGMENTS} SELECT user_id, CAST(segment AS BIGINT) AS segment, min(s) AS start, max(s) AS "end", count(*) AS n FROM g GROUP BY ALL')
def session_segments(t: Tables) -> DataFrame:
    """Gap-tolerant segments of each user's events."""
    rows = windows.segments(_events(t), ["user_id"], F.col("s"), 1800)
    return windows.segment_bounds(rows, ["user_id"], F.col("s"))


@query(
    "silence_periods",
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, role = 'assistant' AS quiet FROM conversations),
       r AS (SELECT conv_id, n, n - row_number() OVER (PARTITION BY conv_id ORDER BY n) AS run FROM t WHERE quiet)
       SELECT conv_id, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last, count(*) AS length FROM r GROUP BY conv_id, run HAVING count(*) >= 1""",
)
def silence_periods(t: Tables) -> DataFrame:
    """Runs of turns without a user's word, also at the end."""
    return windows.true_runs(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")], F.col("role") == "assistant")


@query(
    "leading_run_length",
    """WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders QUALIFY n <= 6)
       SELECT o_custkey, CAST(coalesce(min(n) FILTER (o_orderstatus <> 'F') - 1, count(*)) AS BIGINT) AS run FROM r GROUP BY 1""",
)
def leading_run_length(t: Tables) -> DataFrame:
    """Of a customer's latest six orders, how many before the first that isn't done."""
    return windows.leading_run(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "F", latest=6)


@query("first_turn_flag", "SELECT conv_id, turn, role, role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) = 1 AS is_first FROM conversations")
def first_turn_flag(t: Tables) -> DataFrame:
    return windows.first_flag(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], F.col("role") == "assistant")


@query(
    "interval_merge",
    f"""WITH i AS (SELECT user_id, event_id, s, s + CAST(floor(value) AS BIGINT) * 60 AS e FROM {_E}),
       m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
       g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
       SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY ALL""",
)
def interval_merge(t: Tables) -> DataFrame:
    """Intervals at most 500 apart joined."""
    rows = _events(t).select("user_id", "s", (F.col("s") + F.col("value").cast("long") * 60).alias("e"))
    return windows.merge_intervals(rows, ["user_id"], "s", "e", 500)


@query(
    "containment_join",
    f"""WITH i AS (SELECT user_id, event_id, s, s + 600 AS e FROM {_E} WHERE event_type = 'click'), o AS (SELECT user_id, event_id, s, s + 86400 AS e FROM {_E} WHERE event_type <> 'click')
       SELECT i.event_id AS a_event_id, o.event_id AS b_event_id FROM i JOIN o ON i.user_id = o.user_id AND i.s >= o.s AND i.e <= o.e""",
)
def containment_join(t: Tables) -> DataFrame:
    """Short intervals within long ones of the same user (J11), joined on buckets of a day."""
    inner = _events(t).where("event_type = 'click'").select("user_id", "event_id", "s", (F.col("s") + 600).alias("e"))
    outer = _events(t).where("event_type <> 'click'").select("user_id", "event_id", "s", (F.col("s") + 86400).alias("e"))
    return joins.contained(inner, outer, ["user_id"], "s", "e", 86400).select("a_event_id", "b_event_id")


@query(
    "answered_turns",
    """WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations)
       SELECT conv_id, turn, answered FROM (SELECT conv_id, turn, role, bool_or(role = 'assistant') OVER (PARTITION BY conv_id, u) AS answered FROM t) WHERE role = 'user'""",
)
def answered_turns(t: Tables) -> DataFrame:
    """Whether the agent answers before the user's next turn."""
    rows = t.conversations.select("conv_id", "turn", "role")
    return joins.answered(rows, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "answered")


@query(
    "as_of_join",
    f"""SELECT c.event_id, v.value AS matched_value FROM (SELECT * FROM {_E} WHERE event_type = 'click') c
       ASOF LEFT JOIN (SELECT user_id, s, max(value) AS value FROM {_E} WHERE event_type <> 'click' GROUP BY ALL) v ON c.user_id = v.user_id AND c.s >= v.s""",
)
def as_of_join(t: Tables) -> DataFrame:
    """The latest other event at or before each click."""
    clicks = _events(t).where("event_type = 'click'").select("event_id", "user_id", "s")
    others = _events(t).where("event_type <> 'click'").groupBy("user_id", "s").agg(F.max("value").alias("value"))
    return joins.as_of(clicks, others, ["user_id"], "s", "s", ["value"]).select("event_id", "matched_value")


@query(
    "contiguous_merge",
    """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL OR role = 'system' OR coalesce(lag(role) OVER w = 'system', false) THEN 1 ELSE 0 END AS b
         FROM (SELECT conv_id, turn // 2 * 2 + 1 AS turn, max(role) AS role, string_agg(text, ' ' ORDER BY turn, role, text) AS text FROM conversations GROUP BY ALL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
       g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
       SELECT conv_id, CAST(run AS BIGINT) AS run, max(role) AS kind, CAST(min(turn) AS BIGINT) AS first, CAST(max(turn) AS BIGINT) AS last, count(*) AS n, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha FROM g GROUP BY conv_id, run""",
)
def contiguous_merge(t: Tables) -> DataFrame:
    """Messages of one role in a row become one; system messages are barriers."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), " ")
    pairs = t.conversations.groupBy("conv_id", (F.floor(F.col("turn") / 2) * 2 + 1).cast("long").alias("at")).agg(F.max("role").alias("role"), joined.alias("text"))
    out = windows.merge_contiguous(pairs, ["conv_id"], "at", F.col("role"), "text", F.col("role") == "system")
    return out.withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query("renumbered_turns", "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) - 1 AS INTEGER) AS turn_idx FROM conversations")
def renumbered_turns(t: Tables) -> DataFrame:
    return windows.renumber(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn"), F.col("role")])


@query(
    "text_cursor",
    """WITH f AS (SELECT conv_id, turn, first_value(text) OVER w AS text, CASE WHEN lead(turn) OVER w IS NULL THEN 1.0 ELSE ((turn + 1) % 4 + 1) / 5.0 END AS ratio FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
       t AS (SELECT conv_id, turn, text, least(CAST(max(ceil(ratio * length(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER), length(text)) AS t2 FROM f),
       p AS (SELECT conv_id, turn, text, t2, coalesce(lag(t2) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS t1 FROM t)
       SELECT conv_id, turn, substr(text, CAST(t1 AS BIGINT) + 1, CAST(t2 - t1 AS BIGINT)) AS piece FROM p""",
)
def text_cursor(t: Tables) -> DataFrame:
    """Whole texts dealt out by the cursor (W16): the last turn takes what is left, so the pieces make up the text."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    ratio = F.when(F.lead("turn").over(order).isNull(), 1.0).otherwise(((F.col("turn") + 1) % 4 + 1) / 5.0)
    rows = t.conversations.select("conv_id", "turn", F.first("text").over(order).alias("text"), ratio.alias("ratio"))
    return windows.text_cursor(rows, ["conv_id"], [F.col("turn")], F.col("ratio"), "text").select("conv_id", "turn", "piece")


@query(
    "onestop_self_join",
    f"""WITH l AS (SELECT event_id, user_id % 20 AS a, CAST(floor(value) AS BIGINT) % 20 AS b, s // 86400 AS d, s AS dep, s + 3600 AS arr FROM {_E})
       SELECT x.event_id AS event_id_1, y.event_id AS event_id_2 FROM l x JOIN l y ON x.b = y.a AND x.d = y.d AND y.dep >= x.arr""",
)
def onestop_self_join(t: Tables) -> DataFrame:
    """Connections of two legs on a day."""
    legs = _events(t).select("event_id", (F.col("user_id") % 20).alias("a"), (F.col("value").cast("long") % 20).alias("b"), F.floor(F.col("s") / 86400).alias("d"), F.col("s").alias("dep"), (F.col("s") + 3600).alias("arr"))
    return joins.two_legs(legs, "a", "b", "d", "dep", "arr").select("event_id_1", "event_id_2")


@query(
    "turn_position_share",
    """SELECT role, turn, count(*) AS n, round(count(*) FILTER (length(text) > 100) / count(*), 6) AS share FROM conversations GROUP BY ALL""",
)
def turn_position_share(t: Tables) -> DataFrame:
    """Share of turns off target by role and position."""
    off = F.length("text") > 100
    return t.conversations.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(off) / F.count(F.lit(1)), 6).alias("share"))


@query(
    "first_drift_turn",
    """WITH f AS (SELECT conv_id, min(turn) FILTER (length(text) > 100) AS first, count(*) AS n, count(*) FILTER (length(text) > 100) AS off FROM conversations GROUP BY 1)
       SELECT count(*) AS runs, count(first) AS drifted, median(first) AS median_first, round(sum(off) / sum(n), 6) AS share FROM f""",
)
def first_drift_turn(t: Tables) -> DataFrame:
    """The median of each conversation's first turn off target."""
    off = F.length("text") > 100
    each = t.conversations.groupBy("conv_id").agg(F.min(F.when(off, F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))
    return each.agg(F.count(F.lit(1)).alias("runs"), F.count("first").alias("drifted"), F.median("first").alias("median_first"), F.round(F.sum("off") / F.sum("n"), 6).alias("share"))


@query(
    "incorrect_turns",
    """SELECT conv_id, count(*) AS total, count(*) FILTER (length(text) <= 100) AS correct, list_sort(coalesce(list(turn) FILTER (length(text) > 100), [])) AS incorrect FROM conversations GROUP BY 1""",
)
def incorrect_turns(t: Tables) -> DataFrame:
    """Counts and the list of turns off target."""
    off = F.length("text") > 100
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~off).alias("correct"), F.array_sort(F.collect_list(F.when(off, F.col("turn")))).alias("incorrect"))


@query(
    "unresponsive_runs",
    """WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
       w AS (SELECT conv_id, g, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM t GROUP BY ALL)
       SELECT conv_id, CAST(sum(u) AS BIGINT) AS user_turns, CAST(sum(a) AS BIGINT) AS agent_turns, max(u) AS longest_wait, max(u) >= 3 AS unresponsive FROM w GROUP BY 1""",
)
def unresponsive_runs(t: Tables) -> DataFrame:
    return ticks.responsiveness(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant")


def tick_table(t: Tables) -> DataFrame:
    """Two channels made of events: clicks are one side's words, other events the other's."""
    from pyspark.sql import Window

    rows = t.events.select(F.col("user_id").alias("conv_id"), "event_id", "event_type", "ts")
    rows = rows.withColumn("tick", F.row_number().over(Window.partitionBy("conv_id").orderBy("ts", "event_id")) - 1)
    word = F.concat(F.col("event_id").cast("string"), F.lit(" "))
    return rows.select("conv_id", "tick", F.when(F.col("event_type").isin("click", "view"), word).alias("own"), F.when(F.col("event_type") != "click", word).alias("other"))


#: The table of :func:`tick_table` in SQL.
TICKS = """(SELECT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS tick, CASE WHEN event_type IN ('click', 'view') THEN event_id || ' ' END AS own, CASE WHEN event_type <> 'click' THEN event_id || ' ' END AS other FROM events)"""


@query(
    "linearize_containment",
    f"""WITH w AS (SELECT conv_id, tick, 1 AS priority, own AS word FROM {TICKS} WHERE own IS NOT NULL UNION ALL SELECT conv_id, tick, 0, other FROM {TICKS} WHERE other IS NOT NULL),
       g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, priority ORDER BY tick) AS segment FROM (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY conv_id, priority ORDER BY tick) <= 1 THEN 0 ELSE 1 END AS b FROM w)),
       s AS (SELECT conv_id, priority, segment, min(tick) AS low, max(tick) AS high FROM g GROUP BY ALL),
       held AS (SELECT s.conv_id, s.priority, s.segment, bool_or(x.low <= s.low AND s.high <= x.high AND (x.low, x.high) <> (s.low, s.high)) AS held FROM s JOIN s x ON s.conv_id = x.conv_id AND s.priority <> x.priority GROUP BY ALL),
       placed AS (
         SELECT g.conv_id, g.priority, g.segment, g.tick, any_value(g.word) AS word, any_value(CASE WHEN coalesce(h.held, false) THEN s.high + 0.25 ELSE s.low END) AS at_first,
                max(x.high) FILTER (x.low >= s.low AND x.high <= s.high AND (x.low, x.high) <> (s.low, s.high) AND x.high < g.tick) AS passed
         FROM g JOIN s USING (conv_id, priority, segment) LEFT JOIN held h USING (conv_id, priority, segment) LEFT JOIN s x ON x.conv_id = g.conv_id AND x.priority <> g.priority GROUP BY ALL),
       parts AS (SELECT conv_id, priority, segment, coalesce(passed + 0.5, at_first) AS place, string_agg(word, '' ORDER BY tick) AS content FROM (SELECT conv_id, priority, segment, tick, word, at_first, passed FROM placed) GROUP BY ALL)
       SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place, priority) - 1 AS INTEGER) AS pos, CASE priority WHEN 1 THEN 'assistant' ELSE 'user' END AS role, content FROM parts""",
)
def linearize_containment(t: Tables) -> DataFrame:
    """Transcripts in which contained speech splits its container."""
    return ticks.linear_transcript(tick_table(t), "conv_id", "tick", "own", "other")


@query(
    "linearize_consolidated",
    f"""WITH r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY tick) AS region FROM (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY conv_id ORDER BY tick) <= 2 THEN 0 ELSE 1 END AS b FROM {TICKS} WHERE own IS NOT NULL OR other IS NOT NULL)),
       p AS (SELECT conv_id, region, 0 AS priority, string_agg(other, '' ORDER BY tick) AS content FROM r WHERE other IS NOT NULL GROUP BY ALL UNION ALL SELECT conv_id, region, 1, string_agg(own, '' ORDER BY tick) FROM r WHERE own IS NOT NULL GROUP BY ALL),
       m AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY region, priority) AS run FROM (SELECT *, CASE WHEN priority = lag(priority) OVER (PARTITION BY conv_id ORDER BY region, priority) THEN 0 ELSE 1 END AS c FROM p))
       SELECT conv_id, CAST(run - 1 AS INTEGER) AS pos, CASE any_value(priority) WHEN 1 THEN 'assistant' ELSE 'user' END AS role, string_agg(content, '' ORDER BY region) AS content FROM m GROUP BY conv_id, run""",
)
def linearize_consolidated(t: Tables) -> DataFrame:
    """Transcripts region by region."""
    return ticks.linear_transcript(tick_table(t), "conv_id", "tick", "own", "other", "consolidated", gap=2)


@query(
    "tick_segments",
    """WITH t AS (SELECT user_id AS conv_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events),
       o AS (SELECT conv_id, tick, event_id || ' ' AS word, CASE WHEN tick - lag(tick) OVER (PARTITION BY conv_id ORDER BY tick) <= 2 THEN 0 ELSE 1 END AS b FROM t WHERE event_type IN ('click', 'view')),
       g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY tick) AS segment FROM o)
       SELECT conv_id, CAST(segment AS BIGINT) AS segment, CAST(min(tick) AS INTEGER) AS start, CAST(max(tick) AS INTEGER) AS "end", string_agg(word, '' ORDER BY tick) AS text FROM g GROUP BY conv_id, segment""",
)
def tick_segments(t: Tables) -> DataFrame:
    return ticks.speech_segments(tick_table(t), ["conv_id"], "tick", "own", 2)


@query(
    "tick_messages",
    """WITH t AS (SELECT user_id AS conv_id, event_id || ' ' AS word, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events)
       SELECT conv_id, CAST(tick AS INTEGER) AS tick, 0 AS priority, 'assistant' AS role, word AS content FROM t WHERE event_type IN ('click', 'view') UNION ALL SELECT conv_id, CAST(tick AS INTEGER), 1, 'user', word FROM t WHERE event_type <> 'click'""",
)
def tick_messages(t: Tables) -> DataFrame:
    """Ticks to messages, one side first."""
    return ticks.tick_messages(tick_table(t), ["conv_id"], "tick", {"own": "assistant", "other": "user"})


@query("expanded_ticks", "WITH t AS (SELECT user_id AS conv_id, ts, event_id, event_type FROM events) SELECT conv_id, count(*) + count(*) FILTER (event_type = 'click') AS n, count(*) + count(*) FILTER (event_type = 'click') - 1 AS last FROM t GROUP BY 1")
def expanded_ticks(t: Tables) -> DataFrame:
    """Ticks with a result become two, renumbered."""
    rows = tick_table(t).withColumn("result", F.when(F.col("other").isNull(), F.col("own")))
    return ticks.expand_results(rows, ["conv_id"], "tick", "result").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("new_tick").cast("long").alias("last"))


@query(
    "closed_intervals",
    f"""WITH e AS (SELECT user_id, event_id, event_type, s * 1000000 + event_id % 1000000 AS t, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s * 1000000 + event_id % 1000000) AS d FROM {_E})
       SELECT o.event_id, coalesce(min(c.t), -1) AS closed_at FROM e o LEFT JOIN e c ON c.user_id = o.user_id AND c.t > o.t AND c.d < o.d WHERE o.event_type = 'view' GROUP BY ALL""",
)
def closed_intervals(t: Tables) -> DataFrame:
    """Each opening event with the closing one that belongs to it, last in first out."""
    rows = _events(t).withColumn("at", F.col("s") * 1_000_000 + F.col("event_id") % 1_000_000)
    return ticks.close_intervals(rows, ["user_id"], "at", F.col("event_type") == "view", F.col("event_type") == "click", F.lit(-1).cast("long")).select("event_id", "closed_at")
