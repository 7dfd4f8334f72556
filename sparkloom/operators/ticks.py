"""Tick streams of two parties: segments, silences, overlaps, and linear transcripts.

A tick row holds what each side said in it (``self``, ``other``; NULL is silence). Linear transcripts
need a sequential scan with splits, so each conversation travels as one sorted array; a conversation
is bounded, all else is window expressions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.grouped import scan_groups
from sparkloom.operators.windows import true_runs

STRATEGIES = ("timestamp", "self_first", "other_first", "consolidated", "containment_aware")


def speech_segments(ticks: DataFrame, keys: list[str], tick: str, text: str, gap: int) -> DataFrame:
    """One side's segments: ticks with speech at most ``gap`` apart."""
    spoken = ticks.where(F.col(text).isNotNull())
    order = Window.partitionBy(*keys).orderBy(tick)
    begins = F.coalesce((F.col(tick) - F.lag(tick).over(order) > gap).cast("int"), F.lit(1))
    rows = spoken.withColumn("__b", begins).withColumn("segment", F.sum("__b").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(tick).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*keys, "segment").agg(F.min(tick).alias("start"), F.max(tick).alias("end"), joined.alias("text"))


def silences(ticks: DataFrame, keys: list[str], tick: str, sides: list[str], least: int) -> DataFrame:
    """Runs of ticks in which nobody speaks, also one at the end."""
    quiet = F.lit(True)
    for side in sides:
        quiet = quiet & F.col(side).isNull()
    return true_runs(ticks, keys, [F.col(tick)], quiet, least)


def responsiveness(turns: DataFrame, keys: list[str], position: str, is_user: Column, is_agent: Column, least: int = 3) -> DataFrame:
    """Segments by role and the longest run of user turns without an answer."""
    order = Window.partitionBy(*keys).orderBy(position)
    rows = turns.withColumn("__u", is_user).withColumn("__a", is_agent).withColumn("__g", F.sum(F.col("__a").cast("int")).over(order))
    waits = rows.groupBy(*keys, "__g").agg(F.count_if("__u").alias("u"), F.count_if("__a").alias("a"))
    longest = F.max("u")
    return waits.groupBy(*keys).agg(F.sum("u").alias("user_turns"), F.sum("a").alias("agent_turns"), longest.alias("longest_wait"), (longest >= least).alias("unresponsive"))


def _segments(words: dict[int, str], gap: int, barriers: Iterable[int] = ()) -> list[dict[int, str]]:
    """Cut a side's words into segments at gaps and behind barriers."""
    stops = sorted(barriers)
    out: list[dict[int, str]] = []
    before = None
    for tick in sorted(words):
        if before is None or tick - before > gap or bisect_left(stops, before) < bisect_left(stops, tick):
            out.append({})
        out[-1][tick] = words[tick]
        before = tick
    return out


def _contained(own: list[dict[int, str]], other: list[dict[int, str]], own_role: str, other_role: str) -> list[tuple[float, int, str, str]]:
    """Order segments by start, the other side first on a tie; a contained one splits its container behind itself.

    Of two that cover the same ticks neither contains the other.
    """
    out: list[tuple[float, int, str, str]] = []
    for mine, theirs, role, priority in ((own, other, own_role, 1), (other, own, other_role, 0)):
        # A side's segments don't overlap, so those that lie within a span, or hold it, are found by search.
        bounds = [(min(t), max(t)) for t in theirs]
        starts_at, ends_at = [low for low, _ in bounds], [high for _, high in bounds]
        for segment in mine:
            span = min(segment), max(segment)
            within = bounds[bisect_left(starts_at, span[0]) : bisect_right(ends_at, span[1])]
            cuts = [high for low, high in within if (low, high) != span]
            at = bisect_right(starts_at, span[0]) - 1
            holder = at >= 0 and ends_at[at] >= span[1] and bounds[at] != span
            # A contained segment comes behind its container's part that ends with it.
            place = (span[1] + 0.25, priority) if holder else (float(span[0]), priority)
            parts: list[list[str]] = [[]]
            starts: list[float] = [place[0]]
            ticks = sorted(segment)
            for tick in ticks:
                while cuts and tick > cuts[0]:
                    if parts[-1]:
                        parts.append([])
                        starts.append(cuts[0] + 0.5)
                    else:
                        starts[-1] = cuts[0] + 0.5
                    cuts.pop(0)
                parts[-1].append(segment[tick])
            out += [(at, place[1], role, "".join(p)) for at, p in zip(starts, parts, strict=True) if p]
    return sorted(out, key=lambda x: (x[0], x[1]))


def linearize(own: dict[int, str], other: dict[int, str], strategy: str = "containment_aware", gap: int = 1, own_role: str = "assistant", other_role: str = "user", barriers: Iterable[int] = ()) -> list[tuple[str, str]]:
    """``(role, text)`` in order (M02-M06). ``barriers`` are ticks of tool calls, which end segments."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "containment_aware":
        return [(role, text) for _, _, role, text in _contained(_segments(own, gap, barriers), _segments(other, gap, barriers), own_role, other_role)]
    pieces: list[tuple[str, str]] = []
    if strategy == "consolidated":
        # Within a region in which anyone speaks (gaps bridged), all of the other side, then all of one's own.
        for region in _segments({t: "" for t in {*own, *other}}, gap, barriers):
            for words, role in ((other, other_role), (own, own_role)):
                text = "".join(words[t] for t in sorted(region) if t in words)
                if text:
                    pieces.append((role, text))
    else:
        first_own = strategy == "self_first"
        for tick in sorted({*own, *other}):
            sides = [(own, own_role), (other, other_role)] if first_own else [(other, other_role), (own, own_role)]
            pieces += [(role, words[tick]) for words, role in sides if tick in words]
    merged: list[tuple[str, str]] = []
    for role, text in pieces:
        if merged and merged[-1][0] == role:
            merged[-1] = role, merged[-1][1] + text
        else:
            merged.append((role, text))
    return merged


def linear_transcript(ticks: DataFrame, key: str, tick: str, own: str, other: str, strategy: str = "containment_aware", gap: int = 1, tool: str | None = None) -> DataFrame:
    """``key, pos, role, content`` of each conversation."""

    def scan(rows: list[dict]) -> list[tuple]:
        sides = [{r[tick]: r[side] for r in rows if r[side] is not None} for side in (own, other)]
        stops = [r[tick] for r in rows if r[tool] is not None] if tool else []
        return [(k, role, content) for k, (role, content) in enumerate(linearize(*sides, strategy=strategy, gap=gap, barriers=stops))]

    return scan_groups(ticks, key, tick, [own, other, *([tool] if tool else [])], scan, "pos int, role string, content string")


def expand_results(ticks: DataFrame, keys: list[str], tick: str, result: str) -> DataFrame:
    """A tick with a tool result becomes two, the result first; renumbered."""
    parts = F.when(F.col(result).isNotNull(), F.array(F.lit("result"), F.lit("speech"))).otherwise(F.array(F.lit("speech")))
    rows = ticks.withColumn("part", F.explode(parts)).withColumn("__o", (F.col("part") == "speech").cast("int"))
    return rows.withColumn("new_tick", F.row_number().over(Window.partitionBy(*keys).orderBy(tick, "__o")) - 1).drop("__o")


def tick_messages(ticks: DataFrame, keys: list[str], tick: str, sides: dict[str, str]) -> DataFrame:
    """A tick's non-NULL columns as rows in the order of ``sides``."""
    parts = F.array(*(F.struct(F.lit(k).alias("priority"), F.lit(role).alias("role"), F.col(c).cast("string").alias("content")) for k, (c, role) in enumerate(sides.items())))
    rows = ticks.select(*keys, tick, F.explode(F.filter(parts, lambda p: p["content"].isNotNull())).alias("m"))
    return rows.select(*keys, tick, "m.*")


def close_intervals(events: DataFrame, keys: list[str], at: str, opens: Column, closes: Column, end: Column | None = None) -> DataFrame:
    """Pair each closing event with the latest open one before it (M13, M15): last in, first out.

    Depth counts open intervals; an opening and the first closing at its depth after it belong together.
    Intervals that stay open end at ``end``.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = events.withColumn("__s", step).where("__s <> 0").withColumn("__d", F.sum("__s").over(order))
    rows = rows.withColumn("__level", F.when(F.col("__s") == 1, F.col("__d")).otherwise(F.col("__d") + 1))
    nested = Window.partitionBy(*keys, "__level").orderBy(at)
    rows = rows.withColumn("__next", F.lead(at).over(nested)).withColumn("__next_s", F.lead("__s").over(nested))
    closed = F.when(F.col("__next_s") == -1, F.col("__next"))
    return rows.where("__s = 1").withColumn("closed_at", F.coalesce(closed, end) if end is not None else closed).drop("__s", "__d", "__level", "__next", "__next_s")


def open_at(intervals: DataFrame, by: list[str], start: str, end: str, at: Column) -> DataFrame:
    """Whether an interval is open at a time."""
    return intervals.groupBy(*by).agg(F.bool_or((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))).alias("is_open"))


def call_segments(ticks: DataFrame, keys: list[str], tick: str, call: str, result: str) -> DataFrame:
    """Tool calls from the tick they are made in to the tick of their result."""
    calls = ticks.where(F.col(call).isNotNull()).select(*keys, F.col(call).alias("id"), F.col(tick).alias("start"))
    results = ticks.where(F.col(result).isNotNull()).groupBy(*keys, F.col(result).alias("id")).agg(F.min(tick).alias("end"))
    return calls.join(results, [*keys, "id"], "left")


def reaction_chance(waited: str | Column, least: int, most: int, rate: float, seconds: float) -> Column:
    """Chance to react in a tick: none under a least wait, sure from a most, Poisson between."""
    w = F.col(waited) if isinstance(waited, str) else waited
    return F.when(w < least, 0.0).when(w >= most, 1.0).otherwise(1 - F.exp(F.lit(-rate * seconds)))


def ramp_chance(waited: str | Column, start: int, end: int) -> Column:
    """Chance that grows from 0 to 1 over a span of ticks."""
    w = F.col(waited) if isinstance(waited, str) else waited
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (w - start) / float(max(1, end - start))))


def lossy_ticks(ticks: DataFrame, key: str, tick: str, good_to_bad: float, bad_to_good: float, seed: int = 0) -> DataFrame:
    """Mark ticks lost by a two-state chain (M17); draws are hashes, so the marks never change.

    The state after a tick is that of the last tick which sets it: a draw low enough to enter, or high
    enough to leave, whatever the state was. Others keep it, which is a running last value.
    """
    from sparkloom.operators.sampling import unit_hash

    enter, leave = F.col("__u") < good_to_bad, F.col("__u") >= 1 - bad_to_good
    rows = ticks.withColumn("__u", unit_hash([key, tick], seed)).withColumn("__set", F.when(enter, True).when(leave, False))
    order = Window.partitionBy(key).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("lost", F.coalesce(F.last("__set", ignorenulls=True).over(order), F.lit(False))).drop("__u", "__set")


def due_events(ticks: DataFrame, schedule: DataFrame, key: str, tick: str, at: str) -> DataFrame:
    """Events for the first tick at or after their time (M18): an equality join on that tick."""
    width = ticks.groupBy(key).agg(F.array_sort(F.collect_set(tick)).alias("__t"))
    due = schedule.join(width, key).withColumn(tick, F.array_min(F.filter("__t", lambda t: t >= F.col(at)))).drop("__t")
    return ticks.join(due.where(F.col(tick).isNotNull()), [key, tick])


def proportional_transcript(ticks: DataFrame, words: DataFrame, keys: list[str], tick: str, start: str, end: str, text: str, gap: int) -> DataFrame:
    """Recognised words merged to utterances and dealt out over the ticks they cover.

    Each tick shows the share of the utterance that has been spoken by its end.
    """
    from sparkloom.operators.windows import merge_intervals, text_cursor

    utterances = merge_intervals(words, keys, start, end, gap, text)
    covered = utterances.withColumn(tick, F.explode(F.sequence(F.col(start), F.col(end))))
    rows = ticks.select(*keys, tick).join(covered, [*keys, tick])
    ratio = (F.col(tick) - F.col(start) + 1) / (F.col(end) - F.col(start) + 1)
    return text_cursor(rows, [*keys, "island"], [F.col(tick)], ratio, text)
