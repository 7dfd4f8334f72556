"""Nested traces to flat rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simulation_rows(sims: DataFrame) -> DataFrame:
    """A simulation's scalar columns, NULL where a nested value lacks."""
    r = F.col("reward_info")
    return sims.select(
        "id", "task_id", "trial", "seed", "duration", "termination_reason", "agent_cost", "user_cost", r["reward"].alias("reward"), r["db_check"]["db_match"].alias("db_match"),
        F.size(F.coalesce("messages", F.array())).alias("num_messages"), F.coalesce(F.size(r["action_checks"]), F.lit(0)).alias("num_checks"),
    )


def flat_runs(runs: DataFrame) -> DataFrame:
    """All 24 scalar columns of each simulation with those of its run (P01); nested values that lack are NULL.

    ``runs`` has ``info`` and ``simulations`` as the reader gives them. A simulation without messages
    counts those of its ticks.
    """
    rows = ordered_messages(runs.select("info", F.explode("simulations").alias("s")).select("info", "s.*"))
    i = F.col("info")
    return rows.select(
        F.col("id").alias("simulation_id"), "task_id", "trial", "seed", F.col("reward_info.reward").alias("reward"), "agent_cost", "user_cost", "termination_reason", "duration", F.coalesce(F.size("messages"), F.lit(0)).alias("num_messages"),
        *(i[c].alias(f"info_{c}") for c in ("git_commit", "seed", "num_trials", "max_steps", "max_errors")), i["environment_info"]["domain_name"].alias("info_domain"),
        *(i[f"{side}_info"][c].alias(f"info_{side}_{c}") for side in ("user", "agent") for c in ("implementation", "llm", "llm_args")), i["lang_id"].alias("info_lang_id"), i["lang_components"].alias("info_lang_components"),
    )


def transfer_only(actions: Column) -> Column:
    """Exactly one gold action, and one that transfers."""
    return F.coalesce((F.size(actions) == 1) & F.contains(F.lower(F.get(actions, F.lit(0))["name"]), F.lit("transfer")), F.lit(False))


def task_metrics(tasks: DataFrame) -> DataFrame:
    """Counts of a task's actions and assertions; -1 actions for a task that only transfers."""
    c = F.col("evaluation_criteria")
    count = lambda a: F.coalesce(F.size(a), F.lit(0))
    actions = F.coalesce(c["actions"], F.array().cast("array<struct<action_id:string,requestor:string,name:string,arguments:string,compare_args:array<string>>>"))
    return tasks.select(
        "id", F.when(transfer_only(actions), -1).otherwise(F.size(actions)).alias("num_actions"), F.size(F.filter(actions, lambda a: a["requestor"] == "assistant")).alias("num_agent_actions"),
        F.size(F.filter(actions, lambda a: a["requestor"] == "user")).alias("num_user_actions"), count(c["env_assertions"]).alias("num_env_assertions"), count(c["nl_assertions"]).alias("num_nl_assertions"),
    )


def ordered_messages(sims: DataFrame) -> DataFrame:
    """Messages by time, renumbered from 0 (P06, W17); without messages those of the ticks."""
    from_ticks = F.flatten(F.transform("ticks", tick_messages))
    every = F.when(F.size(F.coalesce("messages", F.array())) > 0, F.col("messages")).otherwise(F.coalesce(from_ticks, F.col("messages")))
    keyed = F.array_sort(F.transform(every, lambda m, i: F.struct(F.coalesce(m["timestamp"], F.lit("")).alias("t"), i.alias("i"), m.alias("m"))))
    return sims.withColumn("messages", F.transform(keyed, lambda x, i: x["m"].withField("turn_idx", i)))


def tick_messages(tick: Column) -> Column:
    """A tick's messages: the agent's, its results, the user's, its results."""
    one = lambda c: F.filter(F.array(c), lambda m: m.isNotNull())
    none = F.filter(F.array(tick["agent_chunk"]), lambda m: F.lit(False))
    return F.concat(one(tick["agent_chunk"]), F.coalesce(tick["agent_tool_results"], none), one(tick["user_chunk"]), F.coalesce(tick["user_tool_results"], none))


def reward_flags(sims: DataFrame, writes: list[str]) -> DataFrame:
    """Whether each part of the reward was met, NULL if it isn't in the basis."""
    r = F.col("reward_info")
    part = lambda name: F.when(F.array_contains(r["reward_basis"], name), F.try_element_at(r["reward_breakdown"], F.lit(name)) == 1.0)
    is_write = lambda c: c["action"]["name"].isin(*writes)
    checks = r["action_checks"]
    return sims.select(
        "id", "task_id", "trial", part("DB").alias("db_met"), part("ACTION").alias("action_met"), part("COMMUNICATE").alias("communicate_met"),
        F.size(F.filter(checks, is_write)).alias("num_writes"), F.size(F.filter(checks, lambda c: is_write(c) & c["action_match"])).alias("num_writes_met"),
    )


def action_check_rows(sims: DataFrame) -> DataFrame:
    """One row for each action check."""
    checked = sims.where(F.col("reward_info.action_checks").isNotNull())
    return checked.select("id", "task_id", "trial", F.explode("reward_info.action_checks").alias("c")).select("id", "task_id", "trial", F.col("c.action.name").alias("name"), F.col("c.action.requestor").alias("requestor"), F.col("c.action_match").alias("matched"), F.col("c.tool_type").alias("kind"))


def review_errors(sims: DataFrame) -> DataFrame:
    """Errors of full reviews, or else of reviews of users only, with their source."""
    full = F.transform(F.col("review.errors"), lambda e: e.withField("source", F.when(e["source"].isin("agent", "user"), e["source"]).otherwise(F.lit("agent"))))
    users = F.transform(F.col("user_only_review.errors"), lambda e: e.withField("source", F.lit("user")))
    return sims.select("id", F.posexplode(F.coalesce(full, users)).alias("idx", "e")).select("id", "idx", "e.*")


def domain_table(submissions: DataFrame, key: list[str], domains: list[str], metrics: list[str]) -> DataFrame:
    """One row for each submission and domain, best first."""
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), *(F.col(f"{d}_{m}").alias(m) for m in metrics)) for d in domains)))
    return submissions.select(*key, rows.alias("r")).select(*key, "r.*").orderBy("domain", F.desc(metrics[0]), *key)


def _walk(node: object, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    stack = [(path, node)]
    while stack:
        where, value = stack.pop()
        if isinstance(value, str):
            yield "/".join(where), value
        elif isinstance(value, dict):
            stack += [((*where, str(k)), v) for k, v in reversed(list(value.items()))]
        elif isinstance(value, list):
            stack += [((*where, str(k)), v) for k, v in reversed(list(enumerate(value)))]


def string_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, leaf`` of every string in JSON texts (P15); texts that aren't JSON have none."""
    names = [key, text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[names[0]], batch[names[1]], strict=True):
                try:
                    rows += [(k, p, leaf) for p, leaf in _walk(json.loads(t))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[names[0], "path", "leaf"])

    return df.select(*names).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, path string, leaf string")


def leaf_totals(df: DataFrame, key: str, text: str) -> DataFrame:
    """How many strings a JSON text has, and their characters."""
    return string_leaves(df, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.length("leaf")).alias("characters"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of Markdown texts by their headings, in order, with ids ``001_slug_1``."""
    from sparkloom.functions.text import slug

    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("heading", F.col("line").rlike(r"^#{1,6}\s"))
    order = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    cut = lines.groupBy(key, "section").agg(body.alias("body"), F.max(F.when(F.col("heading"), F.regexp_replace("line", r"^#{1,6}\s+", ""))).alias("title"))
    cut = cut.withColumn("slug", slug(F.coalesce("title", F.lit(""))))
    same = Window.partitionBy(key, "slug").orderBy("section")
    number = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    return cut.withColumn("section_id", F.concat(F.format_string("%03d", number), F.lit("_"), "slug", F.lit("_"), F.row_number().over(same).cast("string"))).select(key, "section_id", "title", "body")


def nested_counts(df: DataFrame, maps: list[str]) -> DataFrame:
    """Rows of a collection and the sizes of its nested maps."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.coalesce(F.size(m), F.lit(0))).alias(f"{m}_entries") for m in maps))
