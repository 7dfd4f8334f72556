"""Streams of events and ticks: segments, open intervals, idempotent sinks.

Segments, counts and joins are bounded by a watermark. The two forms with state of their own, leading turns and open
intervals, keep a number or the open intervals of each key, and give a key up only if ``idle`` is set: without rows for so
many milliseconds of processing time. They put a key's rows of one trigger in order in memory, so rows of a key mustn't come
in a later trigger than rows that follow them; :mod:`turns` shows the form that waits for the watermark instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.sources.sinks import one_per_key


def event_stream(spark, folder: str, schema: str, file_glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def stream_segments(events: DataFrame, keys: list[str], ts: str, gap: str, late: str, extra: list[Column] | None = None) -> DataFrame:
    """Gap-tolerant segments as session windows (W04): emitted once the watermark has passed them."""
    windowed = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    out = windowed.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end"), *(extra or []))
    return out.withColumn("start", F.col("w.start")).drop("w")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts by time window with a bound on lateness."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide or width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def correlate(events: DataFrame, item: str, kind: str, ts: str, kinds: list[str], late: str | None = None) -> DataFrame:
    """The times of several kinds of events of one item (M20): one aggregation instead of joins."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(item).agg(*(F.min(F.when(F.col(kind) == k, F.col(ts))).alias(k) for k in kinds))


def correlate_streams(events: DataFrame, item: str, kind: str, ts: str, kinds: list[str], within: str, late: str) -> DataFrame:
    """Each event of the first kind with those of the other kinds of its item that follow ``within`` a time (M20): ``item`` and a time for each kind.

    Kinds are joined as streams, so state reaches back no further than ``within`` and ``late`` before the watermark. A
    kind that doesn't come is NULL, told once the watermark has passed the time in which it could.
    """
    first, *others = kinds
    out = events.where(F.col(kind) == first).select(item, F.col(ts).alias(first)).withWatermark(first, late)
    for k in others:
        other = events.where(F.col(kind) == k).select(F.col(item).alias("__item"), F.col(ts).alias(k)).withWatermark(k, late)
        follows = (F.col(item) == F.col("__item")) & (F.col(k) >= F.col(first)) & (F.col(k) <= F.col(first) + F.expr(f"INTERVAL {within}"))
        # Only the first kind's time goes on as the stream's event time: a computed column is none.
        out = out.join(other, follows, "left_outer").drop("__item").withColumn(k, F.timestamp_micros(F.unix_micros(k)))
    return out


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def _in_order(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """All rows of a key in a trigger, by ``order``."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def stream_leading_turns(turns: DataFrame, key: str, position: str, role: str, idle: int | None = None) -> DataFrame:
    """For each turn, how many user turns in a row stand unanswered (A68): ``key, position, waiting``.

    Rows of a key must come in order; the state is one number.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (waiting,) = state.get if state.exists else (0,)
        rows, out = _in_order(batches, position), []
        for at, who in zip(rows[position], rows[role], strict=True):
            waiting = waiting + 1 if who == "user" else 0 if who == "assistant" else waiting
            out.append((k[0], at, waiting))
        yield pd.DataFrame(out, columns=[key, position, "waiting"])
        state.update((waiting,))
        if idle:
            state.setTimeoutDuration(idle)

    kinds = dict(turns.dtypes)
    return turns.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {position} {kinds[position]}, waiting long", "waiting long", "append", _timeout(idle))


def stream_open_intervals(events: DataFrame, key: str, at: str, kind: str, opens: str, closes: str, idle: int | None = None) -> DataFrame:
    """Intervals as they close, the latest opened first (M13, M14): ``key, opened_at, closed_at``.

    The state is the stack of open intervals of a key. Those of a key that is given up end with NULL.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], x, None) for x in stack], columns=[key, "opened_at", "closed_at"]).astype({"closed_at": "Int64"})
            return
        rows, out = _in_order(batches, at), []
        for when, what in zip(rows[at], rows[kind], strict=True):
            if what == opens:
                stack.append(int(when))
            elif what == closes and stack:
                out.append((k[0], stack.pop(), int(when)))
        yield pd.DataFrame(out, columns=[key, "opened_at", "closed_at"])
        state.update((stack,))
        if idle:
            state.setTimeoutDuration(idle)

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {dict(events.dtypes)[key]}, opened_at long, closed_at long", "stack array<long>", "append", _timeout(idle))


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str | None = None) -> StreamingQuery:
    """Write each batch once into its own folder (K05): a batch that is run again replaces itself.

    Of a key's rows in a batch the last by ``order`` is written. Readers keep the last version of a key by batch number, see :func:`latest_versions`.
    """

    def write(batch: DataFrame, number: int) -> None:
        one_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(spark, path: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """The last version of each key that :func:`upsert_sink` has written, or any other writer of partitions ``batch``.

    With a ``schema``, which names the partitions too, a folder without batches is an empty table.
    """
    rows = spark.read.schema(schema).parquet(path) if schema else spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet and stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
