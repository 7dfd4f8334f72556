"""Joins beyond plain equality: ranges, containment, self joins, lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.workspace import workspace

#: Legs of one place and day that meet in a task, of each side, about; those of them that are paired together.
SLICE, BLOCK = 8_192, 128


def lookup(df: DataFrame, other: DataFrame, keys: list[str], require: bool = False) -> DataFrame:
    """Left join to a dimension (J02, J05, J15); with ``require`` a missing key raises."""
    if not require:
        return df.join(other, keys, "left")
    joined = df.join(other.withColumn("__found", F.lit(True)), keys, "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.lit("a key has no match"))).otherwise(F.lit(None)).cast("string")
    return joined.where(checked.isNull()).drop("__found")


def refreshed(df: DataFrame, newer: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values from ``newer`` where it has them."""
    given = newer.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(given, keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def two_legs(legs: DataFrame, origin: str, destination: str, day: str, departs: str, arrives: str, next_day: Column | None = None) -> DataFrame:
    """Pairs of legs that connect (J06): the second starts where and after the first ends.

    Few rows make many pairs, so the legs of a place and day are dealt out in slices of about ``SLICE`` at most, each of
    one side to each of the other: what a task holds doesn't grow with them. In a slice legs lie in blocks of ``BLOCK``
    by time, and only blocks that can connect are paired. The pairs of two blocks repeat the same few legs in the same
    order, which columnar files store in a tenth of the bytes.
    """
    tasks = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given isn't lowered for being few bytes
    key, met = ["__place", "__day"], ["__place", "__day", "__s1", "__s2"]
    first, second = (legs.select(*(F.col(c).alias(f"{c}_{side}") for c in legs.columns)) for side in (1, 2))
    first = first.withColumns({"__place": F.col(f"{destination}_1"), "__day": F.col(f"{day}_1") if next_day is None else next_day})
    second = second.withColumns({"__place": F.col(f"{origin}_2"), "__day": F.col(f"{day}_2")})
    slices = F.ceil(F.count(F.lit(1)) / SLICE).cast("int")
    sizes = first.groupBy(*key).agg(slices.alias("__n1")).join(second.groupBy(*key).agg(slices.alias("__n2")), key)

    def blocks(df: DataFrame, own: int, other: int, time: str, bound: Column) -> DataFrame:
        columns = [f"{c}_{own}" for c in legs.columns]
        rows = df.join(sizes, key).withColumn(f"__s{own}", F.pmod(F.xxhash64(*columns), F.col(f"__n{own}")).cast("int")).repartition(tasks, *key, f"__s{own}")
        number = F.row_number().over(Window.partitionBy(*key, f"__s{own}").orderBy(time))
        packed = rows.withColumn("__block", F.floor((number - 1) / BLOCK)).groupBy(*key, f"__s{own}", f"__n{other}", "__block").agg(bound.alias(f"__bound{own}"), F.collect_list(F.struct(*columns)).alias(f"__legs{own}"))
        return packed.withColumn(f"__s{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1))).drop(f"__n{other}", "__block").repartition(tasks, *met)

    ends = blocks(first, 1, 2, f"{arrives}_1", F.min(f"{arrives}_1"))
    starts = blocks(second, 2, 1, f"{departs}_2", F.max(f"{departs}_2"))
    paired = ends.join(starts, met).where("__bound2 >= __bound1").select("__legs1", "__legs2")
    # The same number of tasks: it parts the join from what follows, else all pairs of a block would be gathered first.
    pairs = paired.coalesce(tasks).select(F.inline("__legs1"), "__legs2").select(*(f"{c}_1" for c in legs.columns), F.inline("__legs2"))
    return pairs.where(F.col(f"{departs}_2") >= F.col(f"{arrives}_1"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs of an inner interval within an outer one of the same key.

    An inner interval lies within one that covers its start; outer intervals are dealt to buckets of
    ``width``, and an inner one meets only the bucket of its start.
    """
    a = inner.select(*(F.col(c).alias(f"a_{c}") for c in inner.columns)).withColumn("__bin", F.floor(F.col(f"a_{start}") / width))
    b = outer.select(*(F.col(c).alias(f"b_{c}") for c in outer.columns)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(f"b_{start}") / width), F.floor(F.col(f"b_{end}") / width))))
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(f"a_{key}") == F.col(f"b_{key}"))
    within = (F.col(f"a_{start}") >= F.col(f"b_{start}")) & (F.col(f"a_{end}") <= F.col(f"b_{end}"))
    return a.join(b, on & (a["__bin"] == b["__bin"]) & within).drop("__bin")


def answered(df: DataFrame, keys: list[str], position: str, asks: Column, answers: Column) -> DataFrame:
    """Asking rows with whether an answer comes before the next (J12): one window, no range join."""
    order = Window.partitionBy(*keys).orderBy(position)
    rows = df.withColumn("__asks", F.coalesce(asks, F.lit(False))).withColumn("__turn", F.sum(F.col("__asks").cast("int")).over(order))
    found = F.max(F.coalesce(answers, F.lit(False)) & ~F.col("__asks")).over(Window.partitionBy(*keys, "__turn"))
    return rows.withColumn("answered", found).where("__asks").drop("__asks", "__turn")


def as_of(df: DataFrame, other: DataFrame, keys: list[str], at: str, other_at: str, columns: list[str]) -> DataFrame:
    """The latest row of ``other`` at or before each row (J12): a union and a running last, no range join."""
    rows = df.withColumn("__at", F.col(at)).withColumn("__late", F.lit(1)).withColumns({f"__{c}": F.lit(None).cast(dict(other.dtypes)[c]) for c in columns}).withColumn("__has", F.lit(None).cast("int"))
    marks = other.select(*keys, F.col(other_at).alias("__at"), F.lit(0).alias("__late"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(1).alias("__has"))
    order = Window.partitionBy(*keys).orderBy("__at", "__late").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("__has").isNotNull(), F.struct(*(F.col(f"__{c}") for c in columns))), ignorenulls=True).over(order)
    out = rows.unionByName(marks, allowMissingColumns=True).withColumn("__last", latest).where("__late = 1")
    return out.select(*df.columns, *(F.col(f"__last.__{c}").alias(f"matched_{c}") for c in columns))


def assign_segment(points: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, end: str, number: str) -> DataFrame:
    """Each point's segment (J21): of those that end at it or after it the one of the least number, else the key's last; NULL for a key without segments.

    Ends and points of a key are put in falling order, where that number is a running least. The order is made by
    ranges, and what an earlier range has found of a key is handed on, so a key of any size is spread over tasks.
    """
    spark = points.sparkSession
    kind = segments.schema[number].dataType.simpleString()
    ends = segments.where(F.col(end).isNotNull()).select(*keys, F.col(end).alias("__pos"), F.col(number).alias("__n"), F.lit(None).alias("__row"))
    rest = [c for c in points.columns if c not in keys]
    asked = points.select(*keys, F.col(at).alias("__pos"), F.lit(None).cast(kind).alias("__n"), F.struct(*rest).alias("__row"))
    rows = asked.unionByName(ends.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)))
    order = [*keys, F.desc_nulls_first("__pos")]
    path = workspace(spark, "segments")
    rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part")).write.parquet(path)
    rows = spark.read.parquet(path)
    # A point without a place has no segment at or after it; ends come before points of the same place.
    falling = Window.partitionBy(*keys, "__part").orderBy(F.desc_nulls_first("__pos"), F.col("__row").isNotNull())
    found = rows.withColumn("__found", F.min("__n").over(falling.rowsBetween(Window.unboundedPreceding, 0))).where("__row IS NOT NULL")
    # One row for each key and range that it lies in.
    ranges = rows.groupBy(*keys, "__part").agg(F.min("__n").alias("__least"), F.max("__n").alias("__most"))
    key = Window.partitionBy(*keys)
    known = ranges.select(*keys, "__part", F.min("__least").over(key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.max("__most").over(key).alias("__last"))
    given = F.lit(True)
    for c in keys:
        given = given & F.col(c).isNotNull()
    chosen = F.when(given, F.coalesce(F.least("__found", "__before"), "__last")).alias(number)  # least skips NULL
    return found.join(known, [*keys, "__part"], "left").select(*(F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in points.columns if c != number), chosen)


def paired_calls(messages: DataFrame, keys: list[str], position: str, call_id: str, is_call: Column, is_result: Column) -> DataFrame:
    """Calls with the result of the same id that follows (J14); NULL result positions where none does."""
    calls = messages.where(is_call).select(*keys, F.col(call_id).alias("call"), F.col(position).alias("called"))
    results = messages.where(is_result).groupBy(*keys, F.col(call_id).alias("call")).agg(F.min(position).alias("answered"))
    return calls.join(results, [*keys, "call"], "left").withColumn("in_order", F.coalesce(F.col("answered") > F.col("called"), F.lit(False)))


def routed_lookup(ids: DataFrame, id_col: str, routes: dict[str, tuple[DataFrame, str]], value: str) -> DataFrame:
    """Look ids up in the table that their prefix names."""
    parts = [table.select(F.lit(prefix).alias("__prefix"), F.col(key).cast("string").alias("__key"), F.col(value).cast("string").alias("found")) for prefix, (table, key) in routes.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    asked = ids.withColumn("__prefix", F.substring_index(id_col, ":", 1)).withColumn("__key", F.expr(f"substr({id_col}, instr({id_col}, ':') + 1)"))
    return asked.join(every, ["__prefix", "__key"], "left").drop("__prefix", "__key")


def over_grid(df: DataFrame, values: list[str], name: str) -> DataFrame:
    """Rows repeated for each of a short list of values."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def onto_spine(spine: DataFrame, df: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """A frame for each key of a spine, with fill values."""
    return spine.join(df, keys, "left").fillna(fill)
