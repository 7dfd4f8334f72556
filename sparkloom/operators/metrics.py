"""Run metrics: repeated-trial success, action checks, counters over simulations.

Simulations come as a frame with a task, a reward and, where it matters, a termination reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import col, consistency, is_success, no_nan, pass_hat, safe_ratio

#: Terminations that say nothing about the agent, and those counted as errors (fixed values).
INFRASTRUCTURE = ("infrastructure_error",)
ERRORS = ("too_many_errors", "agent_error", "user_error")
SEVERITY_ORDER = ("critical", "minor")


def without_infrastructure_errors(sims: DataFrame, termination: str = "termination") -> DataFrame:
    """Simulations that count for success rates; a NULL termination counts."""
    return sims.where(~F.coalesce(F.col(termination).isin(*INFRASTRUCTURE), F.lit(False)))


def trials_by_task(sims: DataFrame, task: str, success: Column, extra: list[Column] | None = None) -> DataFrame:
    """``task, n, c`` (A02): trials and successes, in one aggregation."""
    return sims.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("c"), *(extra or []))


def largest_k(trials: DataFrame, num_trials: Column | None = None) -> DataFrame:
    """``max_k`` (A02): the least count of trials of a task, at most the run's number of trials."""
    least = F.min("n")
    return trials.agg((F.least(least, F.max(num_trials)) if num_trials is not None else least).alias("max_k"))


def pass_hat_by_task(trials: DataFrame, ks: range | list[int], short: str = "null") -> DataFrame:
    """The frame of :func:`trials_by_task` with a ``pass_hat_k`` for each k."""
    return trials.withColumns({f"pass_hat_{k}": pass_hat("n", "c", k, short) for k in ks})


def mean_pass_hat(trials: DataFrame, ks: range | list[int], by: list[str] | None = None) -> DataFrame:
    """``pass_hat_k`` averaged over the tasks with at least k trials, by group."""
    return trials.groupBy(*(by or [])).agg(*(F.avg(pass_hat("n", "c", k)).alias(f"pass_hat_{k}") for k in ks))


def run_summary(sims: DataFrame, run: list[str], task: str, reward: str, ks: range = range(1, 4), extra: list[Column] | None = None) -> DataFrame:
    """One row for each run: pass^1..3, consistency and given means (A10).

    Rewards count if exactly 1; runs without pass^1 or the last pass^k are left out.
    """
    trials = sims.groupBy(*run, task).agg(F.count(F.col(reward)).alias("n"), F.count_if(F.col(reward) == 1.0).alias("c"), *(extra or []))
    names = [c for c in trials.columns if c not in {*run, task, "n", "c"}]
    out = trials.groupBy(*run).agg(*(F.avg(pass_hat("n", "c", k)).alias(f"pass_hat_{k}") for k in ks), *(F.avg(no_nan(c)).alias(c) for c in names))
    last = f"pass_hat_{ks[-1]}"
    return out.where(F.col("pass_hat_1").isNotNull() & F.col(last).isNotNull()).withColumn("rho", consistency(last, "pass_hat_1"))


def action_totals(checks: DataFrame, by: list[str], matched: Column, kind: Column) -> DataFrame:
    """Totals, matches and shares of actions, all and by kind ``read`` or ``write``."""
    aggs = []
    for name, of in (("total", F.lit(True)), ("read", kind == "read"), ("write", kind == "write")):
        n, hit = F.count_if(of), F.count_if(of & matched)
        aggs += [n.alias(f"{name}_actions"), hit.alias(f"{name}_correct"), F.try_divide(hit.cast("double"), n.cast("double")).alias(f"{name}_share")]
    return checks.groupBy(*by).agg(*aggs)


def failure_pattern(totals: DataFrame, attempted_write: Column) -> DataFrame:
    """A seven-way pattern of what went right among reads and writes."""
    reads_ok, writes_ok = F.col("read_correct") == F.col("read_actions"), F.col("write_correct") == F.col("write_actions")
    pattern = (
        F.when(F.col("total_actions") == 0, "no_actions")
        .when(reads_ok & writes_ok, "all_correct")
        .when(F.col("write_actions") == 0, "read_failure")
        .when((F.col("write_correct") == 0) & ~attempted_write, F.when(reads_ok, "no_write_attempted").otherwise("read_failure_no_write"))
        .when(~writes_ok & reads_ok, "write_failure")
        .otherwise("read_and_write_failure")
    )
    return totals.withColumn("pattern", pattern)


def share_of_group(df: DataFrame, by: list[str], key: str, count: Column | None = None) -> DataFrame:
    """Counts of ``key`` within ``by`` and their share of the group."""
    from pyspark.sql import Window

    n = df.groupBy(*by, key).agg((count if count is not None else F.count(F.lit(1))).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("share", F.try_divide(F.col("n").cast("double"), total.cast("double")))


def counters(sims: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """How many rows fulfil each flag, by group: one pass, no join."""
    return sims.groupBy(*by).agg(*(F.count_if(flag).alias(name) for name, flag in flags.items()))


def termination_flags(termination: str | Column) -> dict[str, Column]:
    """The counters of terminations; other reasons are counted nowhere."""
    t = col(termination)
    return {"user_stop": t == "user_stop", "agent_stop": t == "agent_stop", "max_steps": t == "max_steps", "errors": t.isin(*ERRORS)}


def three_way(flag: str | Column, name: str = "db") -> dict[str, Column]:
    """Match, mismatch and not checked, of a flag that may be NULL."""
    f = col(flag)
    return {f"{name}_match": F.coalesce(f, F.lit(False)), f"{name}_mismatch": F.coalesce(~f, F.lit(False)), f"{name}_not_checked": f.isNull()}


def auth_class(status: str | Column) -> Column:
    """Succeeded, failed, not checked (NULL) or else not needed."""
    s = col(status)
    return F.when(s.isNull(), "not_checked").when(s == "succeeded", "succeeded").when(s == "failed", "failed").otherwise("not_needed")


def severity_counts(errors: DataFrame, by: list[str], source: str = "source", severity: str = "severity") -> DataFrame:
    """Counts by source and severity, NULL severities as ``unknown``."""
    return errors.groupBy(*by, source, F.coalesce(severity, F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def worst_severity(errors: DataFrame, sim: str, severity: str = "severity", position: str = "idx") -> DataFrame:
    """Each simulation's severity: critical before minor before the first of any other, none."""
    s = F.col(severity)
    rank = F.when(s == "critical", 0).when(s == "minor", 1).when(s.isNull(), 3).otherwise(2)
    return errors.groupBy(sim).agg(F.coalesce(F.min_by(s, F.struct(rank, F.col(position))), F.lit("none")).alias("worst"))


def first_critical_source(errors: DataFrame, sim: str, source: str = "source", severity: str = "severity", tick: str = "tick_start", turn: str = "turn_idx", position: str = "idx") -> DataFrame:
    """Who made a simulation's first critical error, by tick, else turn, else last; ties by list order."""
    place = F.coalesce(F.col(tick).cast("double"), F.col(turn).cast("double"), F.lit(float("inf")))
    critical = F.startswith(F.col(severity), F.lit("critical"))
    return errors.groupBy(sim).agg(F.coalesce(F.min_by(F.when(critical, F.col(source)), F.when(critical, F.struct(place, F.col(position)))), F.lit("none")).alias("first_critical"))


def total_cost(messages: DataFrame, sim: str, role: str, cost: str) -> DataFrame:
    """Cost by role, NULL if a message that isn't a tool's lacks one (A58); tokens may lack."""
    priced = messages.where(F.col(role) != "tool")
    return priced.groupBy(sim, role).agg(F.when(F.count_if(F.col(cost).isNull()) == 0, F.sum(cost)).alias("cost"))


def success_ratio(sims: DataFrame, by: list[str], reward: str) -> DataFrame:
    """Share of full rewards by group, rounded half to even."""
    return sims.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_success(reward)).alias("c")).withColumn("ratio", safe_ratio("c", "n"))


def failed_only(sims: DataFrame, reward: str) -> DataFrame:
    """Simulations without full reward (F18); one without a reward has failed."""
    return sims.where(~is_success(reward))


def never_solved(sims: DataFrame, task: str, reward: str) -> DataFrame:
    """All simulations of the tasks that no trial solved (F18): an anti-join on solved tasks, which a hot task can't skew."""
    return sims.join(sims.where(is_success(reward)).select(task).distinct(), task, "left_anti")
