"""Grouped analytics: pivots, grouping sets, correlations, shares, bootstrap intervals."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.draws import unit_draws
from sparkloom.functions.stats import correlation, no_nan, rate_or_zero, standard_error
from sparkloom.functions.text import is_blank
from sparkloom.sources.workspace import workspace

#: Draws of a stretch, of those hashed together, and of a task.
DRAWS, DRAWS_TOGETHER, TASK_DRAWS = 1 << 17, 1 << 14, 1 << 23
#: Values of a block are those whose numbers share all but so many bits; 16 at most.
HIT_BITS = 14


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each key and metric that is there (A13); NaN isn't."""
    wide = df.select(*keys, *(no_nan(m).alias(m) for m in metrics))
    return wide.unpivot(keys, metrics, name, value).where(F.col(value).isNotNull())


def pivot_means(df: DataFrame, rows: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """Means with one column for each name, in the given order."""
    return df.groupBy(*rows).pivot(column, names).agg(F.avg(no_nan(value)))


def pivot_sums(df: DataFrame, rows: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """Sums with one column for each name, 0 where there is nothing."""
    return df.groupBy(*rows).pivot(column, names).agg(F.sum(value)).fillna(0, names)


def mean_error_count(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, count and standard error by group (A50, V08); NULL keys are dropped."""
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    x = no_nan(value)
    return kept.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), standard_error(value).alias("sem"))


def mean_and_deviation(df: DataFrame, by: list[str], value: str, population: bool) -> DataFrame:
    """Mean and population (A42, V52) or sample (A43, A44) deviation."""
    x = no_nan(value)
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), (F.stddev_pop(x) if population else F.stddev_samp(x)).alias("sd"))


def by_bucket(df: DataFrame, bucket: str, value: str, spine: DataFrame) -> DataFrame:
    """Means and shares over a spine of buckets, 0 where a bucket is empty."""
    n = df.groupBy(bucket).agg(F.avg(no_nan(value)).alias("mean"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # Both sides of the cross join are aggregates of one row and one row a bucket.
    out = spine.join(n, bucket, "left").fillna(0, ["mean", "n"]).crossJoin(F.broadcast(total))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")), F.lit(0.0))).drop("total")


def share_by_levels(df: DataFrame, levels: list[list[str]], failed: Column, relevant: Column) -> DataFrame:
    """Counts at several grouping levels with shares of failures and of relevant rows.

    ``summary_level`` tells rolled-up keys from keys that are NULL.
    """
    keys = list(dict.fromkeys(itertools.chain(*levels)))
    rows = df.select(*keys, failed.cast("long").alias("__f"), relevant.cast("long").alias("__r"))
    grouped = rows.groupingSets([[F.col(c) for c in level] for level in levels], *(F.col(c) for c in keys)).agg(F.sum("__f").alias("failures"), F.sum("__r").alias("relevant"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("summary_level"))
    total = F.sum("failures").over(Window.partitionBy("summary_level"))
    return grouped.withColumn("failure_share", rate_or_zero(F.col("failures"), total)).withColumn("failure_rate", rate_or_zero(F.col("failures"), F.col("relevant")))


def correlations_by_levels(df: DataFrame, levels: list[list[str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's r of metric pairs at several grouping levels, in one pass."""
    keys = list(dict.fromkeys(itertools.chain(*levels)))
    aggs = [correlation(x, y).alias(f"r_{x}_{y}") for x, y in pairs]
    return df.groupingSets([[F.col(c) for c in level] for level in levels], *(F.col(c) for c in keys)).agg(F.grouping_id().alias("summary_level"), F.count(F.lit(1)).alias("n"), *aggs)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations of all columns as rows."""
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    wide = df.agg(*(correlation(x, y).alias(f"{x}|{y}") for x, y in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs)))
    return wide.select(rows.alias("p")).select("p.*")


def distribution(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each group's shares of a key as text like ``en_0.516|de_0.484`` and as a map.

    Blank keys are dropped; the largest share comes first, ties by key; shares have six digits in the map
    and three in the text, both rounded as SQL engines do: ties of the double's own value to even, where
    ``format_string`` would round those of its shortest decimal up.
    """
    n = df.where(F.trim(F.coalesce(key, F.lit(""))) != "").groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k"))))
    grouped = n.groupBy(*by).agg(F.sum("n").alias("n"), entries.alias("e"))
    share = lambda x: F.rint(-x["m"].cast("double") / F.col("n") * 1e6) / 1e6
    # Of all shares of six digits that end in 500, ``format_number`` takes only this one's double for a tie; it lies above.
    digits = lambda x: F.when(share(x) == 0.0005, "0.001").otherwise(F.format_number(share(x), 3))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["k"], F.lit("_"), digits(x))), "|")
    return grouped.select(*by, "n", text.alias("distribution"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], share(x)))).alias("shares"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def normalise_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's values over their sum, NULL where that is 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), total.cast("double")) for c in columns})


def compare_runs(df: DataFrame, task: str, run: str, passed: Column, runs: list[str]) -> DataFrame:
    """Passes of each task in each run, and a label of how they compare."""
    wide = df.groupBy(task).pivot(run, runs).agg(F.count_if(passed))
    first, last = F.col(f"`{runs[0]}`"), F.col(f"`{runs[-1]}`")
    label = F.when(first.isNull() | last.isNull(), "missing").when(first == last, "same").when(first < last, "better").otherwise("worse")
    return wide.withColumn("label", label)


def against_baseline(df: DataFrame, by: list[str], group: str, baseline: str, value: str) -> DataFrame:
    """Means of the baseline group and of all others, where both are there."""
    base = F.avg(F.when(F.col(group) == baseline, no_nan(value)))
    other = F.avg(F.when(F.col(group) != baseline, no_nan(value)))
    return df.groupBy(*by).agg(base.alias("baseline"), other.alias("others")).where("baseline IS NOT NULL AND others IS NOT NULL").withColumn("gap", F.col("others") - F.col("baseline"))


def _seeded(values: np.ndarray, resamples: int, seed: int, level: float) -> tuple[float, float, float]:
    if not len(values):
        return (float("nan"),) * 3
    mean = float(values.mean())
    if len(values) == 1:
        return mean, mean, mean
    draw = np.random.default_rng(seed)
    means = np.array([values[draw.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
    tail = (1 - level) / 2
    return mean, float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))


def bootstrap_means(df: DataFrame, by: list[str], value: str, resamples: int = 1000, seed: int = 20260625, level: float = 0.95, low: float | None = None, high: float | None = None) -> DataFrame:
    """Percentile bootstrap of the mean by group (A14, A16): ``estimate, ci_low, ci_high``.

    A group without values gives NaN. Values are sorted first, so results don't depend on how rows are dealt. A group goes to one task
    as one sorted array: this is for groups of means (one value for a task and run), not of raw rows.
    """
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(no_nan(value))).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_seeded(np.asarray(v, dtype=np.float64), resamples, seed, level) for v in batch.column(batch.num_columns - 1).to_pylist()]
            bounds = [pa.array([x[k] for x in found], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *bounds], [*batch.schema.names[:-1], "estimate", "ci_low", "ci_high"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields[:-1])
    out = groups.mapInArrow(run, f"{fields}, estimate double, ci_low double, ci_high double")
    if low is not None and high is not None:
        out = out.withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))) for c in ("ci_low", "ci_high")})
    return out


def _drawn(suffix: str, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For stretches of draws the places that they hit in each block of values, a row for each resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix, start, n, b, b_end, j, j_end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = j_end - j
                at = np.empty((b_end - b) * width, np.int64)
                for k in range(0, len(at), DRAWS_TOGETHER):
                    pair = np.arange(k, min(k + DRAWS_TOGETHER, len(at)))
                    at[k : k + len(pair)] = start + np.floor(n * unit_draws(prefix, b + pair // width, j + pair % width, suffix)).astype(np.int64)
                rows: list[tuple] = []
                for resample, row in enumerate(np.sort(at.reshape(-1, width), axis=1), b):
                    block = row >> bits
                    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), width]
                    places = (row & ((1 << bits) - 1)).astype("<u2")
                    rows += [(int(block[x]), start, resample, places[x:y].tobytes()) for x, y in itertools.pairwise(cuts)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["__block", "__start", "b", "hits"])

    return run


def _hit_sums(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums and numbers of the values of a block that each resample hit."""

    def run(values: pa.Table, hits: pa.Table) -> pa.Table:
        held = np.zeros(1 << bits)
        held[values["__at"].to_numpy() & ((1 << bits) - 1)] = values["__v"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), "<u2") for x in hits["hits"]]
        columns = [hits["__start"], hits["b"], pa.array([float(held[x].sum()) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64())]
        return pa.Table.from_arrays(columns, ["__start", "__b", "__s", "__k"])

    return run


def bootstrap_draws(df: DataFrame, by: list[str], value: str, resamples: int = 1000, seed: int = 20260625, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of the mean for groups of any size (A14, A16): ``estimate, ci_low, ci_high``.

    A resample of a group of ``n`` values takes exactly ``n`` draws. Values are numbered by group and size
    through a sort by ranges; draw ``j`` of resample ``b`` hits number ``floor(n * u)``, ``u`` in [0, 1) being 52 bits
    of the MD5 of group, ``b``, ``j`` and seed. So any SQL engine draws the same, and rows may be dealt in any way.
    Draws are dealt out in stretches of at most DRAWS; a task notes which of each HIT_BLOCK values in a row they hit,
    two bytes a draw, and these meet the values of that block: about ``resamples`` times HIT_BLOCK hits whatever the
    size of a group, so no group meets in one task. The work is ``n`` times ``resamples``.

    NULL and NaN values don't count; a group without values gives NaN.
    """
    spark = df.sparkSession
    rows = df.select(*by, no_nan(value).alias("__v")).where("__v IS NOT NULL")
    # Equal values may stand in any order, so a row's number before the sort parts those of a common value.
    ordered = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, "__v", "__tie").sortWithinPartitions(*by, "__v", "__tie")
    path = workspace(spark, "ranked")
    ordered.select(*by, "__v", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")).write.parquet(path)
    ranked = spark.read.parquet(path)
    parts = ranked.groupBy("__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    placed = ranked.join(F.broadcast(parts.select("__part", "__first", before.alias("__before"))), "__part").withColumn("__at", F.col("__before") + F.col("__id") - F.col("__first"))
    groups = placed.groupBy(*by).agg(F.min("__at").alias("__start"), F.count(F.lit(1)).alias("__n"), F.avg("__v").alias("estimate"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    # A stretch of draws: of one resample, or of several of a small group.
    texts = [F.col(c).cast("string") for c in by]
    prefix = F.when(F.coalesce(*texts).isNotNull(), F.concat(F.concat_ws("|", *texts), F.lit("|"))).otherwise("") if by else F.lit("")
    step = F.greatest(F.lit(1), F.floor(F.lit(DRAWS) / F.col("__n")))
    units = groups.select(prefix.alias("prefix"), "__start", "__n", step.alias("__step")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), "__step")))
    units = units.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(DRAWS).cast("long"))))
    units = units.select("prefix", "__start", "__n", "b", F.least(F.col("b") + F.col("__step"), F.lit(resamples)).alias("b_end"), "j", F.least(F.col("j") + DRAWS, F.col("__n")).alias("j_end"))
    total = groups.agg(F.sum("__n")).first()[0] or 0
    tasks = max(1, min(20_000, math.ceil(total * resamples / TASK_DRAWS)))
    hits = units.repartition(tasks).mapInArrow(_drawn(f"|{seed}", HIT_BITS), "__block long, __start long, b int, hits binary")
    values = placed.select(F.shiftright("__at", HIT_BITS).alias("__block"), "__at", "__v")
    sums = values.groupBy("__block").cogroup(hits.groupBy("__block")).applyInArrow(_hit_sums(HIT_BITS), "__start long, __b int, __s double, __k long")
    means = groups.join(sums.groupBy("__start", "__b").agg((F.sum("__s") / F.sum("__k")).alias("__m")), "__start")
    tail = (1 - level) / 2
    bounds = means.groupBy(*by).agg(F.percentile("__m", F.array(F.lit(tail), F.lit(1 - tail))).alias("__q"))  # a mean for each resample
    every = df.select(*by).distinct()
    out = every.join(groups, same(every, groups), "left").select(*(every[c] for c in by), "estimate")
    nan = F.lit(float("nan"))
    return out.join(bounds, same(out, bounds), "left").select(*(out[c] for c in by), F.coalesce("estimate", nan).alias("estimate"), F.coalesce(F.col("__q")[0], nan).alias("ci_low"), F.coalesce(F.col("__q")[1], nan).alias("ci_high"))


def score_summary(scores: DataFrame, by: list[str], sim: str, correct: str, total: str, language: str, top: int = 5) -> DataFrame:
    """Mean score, perfect and drifted simulations, turn accuracy, top drift languages, worst simulations.

    One row for each simulation comes in; the lists hold at most ``top`` entries.
    """
    score = F.try_divide(F.col(correct).cast("double"), F.col(total).cast("double"))
    rows = scores.withColumn("__s", score)
    base = rows.groupBy(*by).agg(
        F.avg("__s").alias("mean_score"), F.count_if(F.col("__s") == 1.0).alias("perfect"), F.count_if(F.col("__s") < 1.0).alias("drifted"), F.try_divide(F.sum(correct).cast("double"), F.sum(total).cast("double")).alias("turn_accuracy")
    )
    drift = top_per_group(rows.where(F.col("__s") < 1.0).groupBy(*by, language).agg(F.count(F.lit(1)).alias("n")), by, [F.desc("n"), F.col(language)], top)
    languages = drift.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", language))), lambda x: x[language]).alias("drift_languages"))
    low = top_per_group(rows.where(F.col("__s").isNotNull()), by, [F.col("__s"), F.col(sim)], top)
    worst = low.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", sim))), lambda x: x[sim]).alias("worst"))
    return base.join(languages, by, "left").join(worst, by, "left")


def domain_percentages(runs: DataFrame, domain: str, metrics: list[str]) -> DataFrame:
    """Metrics of each domain times 100; a domain that comes twice raises, NaN is NULL."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a domain comes twice")).cast("double"))
    return runs.groupBy(domain).agg(*(F.coalesce(once, F.max(no_nan(m) * 100)).alias(m) for m in metrics))


def classify_issues(sims: DataFrame, by: list[str], waiting: str, threshold: int, errors: str) -> DataFrame:
    """Simulations by what went wrong, and how many waited too long."""
    kind = F.when(F.col(errors) > 0, "error").when(F.col(waiting) >= threshold, "unresponsive").otherwise("fine")
    return sims.withColumn("issue", kind).groupBy(*by, "issue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(waiting) >= threshold).alias("over_threshold"))


def or_zero(df: DataFrame, by: list[str], column: str, order: str) -> DataFrame:
    """Each cell's first value by order, 0.0 where there is none."""
    return df.groupBy(*by).agg(F.coalesce(F.min_by(column, order), F.lit(0.0)).alias(column))


def run_pairs(rows: DataFrame, run: list[str], role: str, aggs: dict[str, Column]) -> DataFrame:
    """One row for each run with its figures for both roles side by side (V12): one aggregation, no join."""
    out = []
    for who in ("user", "agent"):
        out += [F.expr(f"max(CASE WHEN {role} = '{who}' THEN {name} END)").alias(f"{who}_{name}") for name in aggs]
    return rows.groupBy(*run, role).agg(*(a.alias(name) for name, a in aggs.items())).groupBy(*run).agg(*out)


def last_by_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """One record for each name, the last by load order."""
    rest = [c for c in df.columns if c not in (name, order)]
    return df.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("r")).select(name, "r.*")


def all_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Whether each check holds for all rows, and whether all do."""
    held = df.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(name) for name, c in checks.items()))
    everything = F.lit(True)
    for name in checks:
        everything = everything & F.col(name)
    return held.withColumn("valid", everything)


def changed_tags(before: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """How often each tag became another, most often first."""
    pairs = before.select(key, F.explode(F.arrays_zip(F.col(old).alias("a"), F.col(new).alias("b"))).alias("p")).where(~F.col("p.a").eqNullSafe(F.col("p.b")))
    return pairs.groupBy(F.col("p.a").alias("old"), F.col("p.b").alias("new")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old", "new")


def stitched_sections(source: DataFrame, override: DataFrame, key: str, section: str, text: str) -> DataFrame:
    """Documents put together from their sections, overridden where there is an override."""
    rows = source.join(override.select(key, section, F.col(text).alias("__o")), [key, section], "left").withColumn("__t", F.coalesce("__o", text))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(section).alias("s"), F.col("__t").alias("t")))), lambda x: x["t"]), "\n").alias(text))


def grouped_units(tools: DataFrame, groups: DataFrame, tool: str, group: str) -> DataFrame:
    """Groups of tools, and tools in none, as units."""
    grouped = groups.groupBy(group).agg(F.array_sort(F.collect_set(tool)).alias("tools")).select(F.col(group).alias("unit"), "tools")
    alone = tools.join(groups.select(tool), tool, "left_anti").select(F.col(tool).alias("unit"), F.array(tool).alias("tools"))
    return grouped.unionByName(alone)


def fan_out(df: DataFrame, key: Column, work: DataFrame | None, process) -> DataFrame:
    """Process each distinct content once and hand the result to all rows that hold it.

    ``process`` takes ``__key, content`` rows and returns ``__key, result``.
    """
    rows = df.withColumn("__key", key)
    distinct = (work if work is not None else rows).groupBy("__key").agg(F.first("content").alias("content"))
    return rows.join(process(distinct), "__key", "left").drop("__key")


def literal_map(df: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """Canonical to localised literals, one target each, the last by order."""
    present = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    return present.groupBy(source).agg(F.max_by(target, order).alias(target))


def shares_of(df: DataFrame, keys: list[str], within: list[str], relevant: Column) -> DataFrame:
    """Counts of each cell with its share of the relevant rows and of all rows of its group (J04): one aggregation, then sums over few cells."""
    cells = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(relevant).alias("relevant"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return cells.withColumns({"share_of_relevant": F.try_divide(F.col("relevant"), F.sum("relevant").over(group)), "share_of_all": F.try_divide(F.col("n"), F.sum("n").over(group))})


def against_mode(df: DataFrame, by: list[str], persona: str, mode: str, solo: str, value: str) -> DataFrame:
    """Means of each persona beside the mean of the solo mode of its group (A48), NULL where there is none."""
    cells = df.groupBy(*by, persona, mode).agg(F.sum(no_nan(value)).alias("__s"), F.count(no_nan(value)).alias("__n"))
    alone = F.col(mode) == solo
    group = Window.partitionBy(*by)
    cells = cells.withColumn("solo_mean", F.try_divide(F.sum(F.when(alone, F.col("__s"))).over(group), F.sum(F.when(alone, F.col("__n"))).over(group)))
    return cells.where(~alone).groupBy(*by, persona).agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("mean"), F.first("solo_mean").alias("solo_mean"))


def language_correctness(turns: DataFrame, run: list[str], position: str, text: str, detected: str, expected: Column) -> DataFrame:
    """Each run's share of turns in the expected language (V17, V19): all turns with a text count, an undetected one as incorrect.

    ``score`` is rounded to four digits and NULL without turns; ``incorrect`` lists positions.
    """
    spoken = ~is_blank(text)
    right = spoken & F.coalesce(F.col(detected) == expected, F.lit(False))
    out = turns.groupBy(*run).agg(
        F.count_if(spoken).alias("turns"), F.count_if(spoken & F.col(detected).isNotNull()).alias("detected"), F.count_if(right).alias("correct"), F.array_sort(F.collect_list(F.when(spoken & ~right, F.col(position)))).alias("incorrect")
    )
    return out.withColumn("score", F.bround(F.try_divide(F.col("correct").cast("double"), F.col("turns").cast("double")), 4))
