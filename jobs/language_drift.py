"""Language drift of conversations, kept up to date as turns arrive.

Each conversation's agent should stay in the language that its user began in. The job streams the
files of a conversation table that it hasn't seen yet (turns of new and of earlier conversations),
labels each turn's language by marker words, and keeps one aggregate for each conversation in the
stream's state. What a run learns goes to ``output`` as new versions of just the conversations that got
turns, in partitions ``batch`` and ``language``; :func:`current` reads the last version of each.

The checkpoint records which files were taken and holds the state, so a run without new files changes
nothing, and a run that broke off is finished by the next: its batch is made again from the same files
and the state before it, and its partitions are overwritten.

    python -m jobs.language_drift --input DIR --output DIR --checkpoint DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import beside, command_line, log, read_config
from sparkloom.functions.text import is_blank, marked_language
from sparkloom.sources.workspace import settings
from sparkloom.streaming.stateful import latest_versions

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
CONFIG = "language_drift.json"


def _drift(language: str, name: str) -> Column:
    """A figure of a language, where it isn't the expected one."""
    return F.when(F.col("language") != language, F.col(f"{name}_{language}"))


def conversations(turns: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """``conv_id, language`` and figures of the agent's turns, from turns (a stream or not).

    ``language`` is that of the first user turn that has one. An agent's turn drifts if it is in another;
    ``score`` is the share of its turns with a text that are in the expected language, to four digits.
    """
    names = sorted(markers)
    rows = turns.withColumn("detected", marked_language("text", markers))
    agent, user = F.col("role") == "assistant", F.col("role") == "user"
    spoken = agent & ~is_blank("text")
    # Only counts and least turns are kept of a language, so that turns may come in any order.
    counts = [F.count_if(spoken & (F.col("detected") == n)).alias(f"n_{n}") for n in names]
    firsts = [F.min(F.when(spoken & (F.col("detected") == n), F.col("turn"))).alias(f"first_{n}") for n in names]
    opening = F.when(user & F.col("detected").isNotNull(), F.struct("turn", "detected"))
    grouped = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(spoken).alias("agent_turns"), F.min(opening).alias("opening"), *counts, *firsts)
    grouped = grouped.withColumn("language", F.col("opening.detected"))
    correct = F.coalesce(*(F.when(F.col("language") == n, F.col(f"n_{n}")) for n in names), F.lit(0))
    drifted = sum((F.coalesce(_drift(n, "n"), F.lit(0)) for n in names[1:]), F.coalesce(_drift(names[0], "n"), F.lit(0)))
    found = F.array_sort(F.array_compact(F.array(*(F.when(_drift(n, "n") > 0, F.struct((-F.col(f"n_{n}")).alias("m"), F.lit(n).alias("l"))) for n in names))))
    share = F.when(F.col("language").isNotNull(), F.bround(F.try_divide(correct.cast("double"), F.col("agent_turns").cast("double")), 4))
    return grouped.select(
        "conv_id", "language", "turns", "agent_turns", correct.alias("correct"), drifted.alias("drifted"), share.alias("score"),
        F.array_min(F.array_compact(F.array(*(_drift(n, "first") for n in names)))).alias("first_drift_turn"), F.array_join(F.transform(found, lambda x: x["l"]), "|").alias("drift_languages"),
    )


def as_glob(path: str) -> str:
    """A pattern that only ``path`` fits: a stream of files takes a folder or a pattern, not a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input_path: str, output: str, checkpoint: str, config: dict) -> int:
    """Take what is new at ``input_path``; returns the number of turns taken."""
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", config["max_files_per_trigger"]).parquet(as_glob(input_path))
    found = conversations(stream, config["markers"])

    def write(batch: DataFrame, number: int) -> None:
        written = Observation(f"batch{number}")
        rows = batch.withColumn("batch", F.lit(number).cast("long")).observe(written, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "language").parquet(output)
        log.info("batch %d: wrote %d versions of conversations to %s", number, written.get["rows"], output)

    # A long backlog takes many batches: all of their figures are kept until the end.
    kept = {"spark__sql__streaming__stateStore__providerClass": config["state_store"], "spark__sql__streaming__numRecentProgressUpdates": "1000000"}
    with settings(spark, **kept):
        query = found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new turns of %s", taken, input_path)
    return taken


def current(spark: SparkSession, output: str) -> DataFrame:
    """The last version of each conversation."""
    return latest_versions(spark, output, ["conv_id"], f"{_versions(spark)}, batch BIGINT, language STRING")


def _versions(spark: SparkSession) -> str:
    empty = conversations(spark.createDataFrame([], TURNS), {"en": ["the"]})
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema if f.name != "language")


def main() -> int:
    args = command_line(__doc__, {"input": "folder of the conversation table", "output": "folder of the results", "checkpoint": "folder of the stream's checkpoint"})
    spark = SparkSession.builder.appName("language drift").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, read_config(spark, args.config) if args.config else beside(__file__, CONFIG))
        log.info("%d conversations stand at %s", current(spark, args.output).count(), args.output)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
