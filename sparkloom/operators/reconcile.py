"""Set differences, content hashes and checks between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.workspace import workspace


def content_hash(columns: list[str]) -> Column:
    """A hash of named values, the same for any column order (R09, R10); NULL differs from any text."""
    return F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit(None)).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def id_diff(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Ids in one table only (R01, R05): ``id, side``."""
    a, b = left.select(id_col).distinct(), right.select(id_col).distinct()
    return a.join(b, id_col, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, id_col, "left_anti").withColumn("side", F.lit("right")))


def row_diff(left: DataFrame, right: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``id, status``: added, removed, changed or same, by content hash."""
    a = left.select(id_col, content_hash(columns).alias("__a"))
    b = right.select(id_col, content_hash(columns).alias("__b"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return a.join(b, id_col, "full_outer").select(id_col, status.alias("status"))


def still_to_do(tasks: DataFrame, done: DataFrame, keys: list[str], termination: str) -> DataFrame:
    """Tasks without a finished run; infrastructure errors don't count as finished."""
    finished = done.where(~F.coalesce(F.col(termination) == "infrastructure_error", F.lit(False)))
    return tasks.join(finished.select(*keys), keys, "left_anti")


def value_diff(left: DataFrame, right: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row for each value that differs (R04, R11): ``id, field, left_value, right_value``."""
    joined = left.select(id_col, *(F.col(c).cast("string").alias(f"l_{c}") for c in columns)).join(right.select(id_col, *(F.col(c).cast("string").alias(f"r_{c}") for c in columns)), id_col, "full_outer")
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in columns)))
    return joined.select(id_col, fields.alias("d")).select(id_col, "d.*").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, kind, value`` of every scalar and every empty object or array in JSON texts, at any depth.

    A path is like ``$["items"][0]``; ``kind`` is ``number``, ``string``, ``boolean``, ``null``, ``object`` or ``array``. Texts
    that aren't JSON, and NULL ones, have none. A level is unfolded after another and written, so that what is
    read again are only the parts that go deeper.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("__k"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    found: list[DataFrame] = []
    while True:
        parts = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit('["'), F.regexp_replace("key", r'(["\\])', r"\\$1"), F.lit('"]'))).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        whole = F.col("pos").isNull()
        out = workspace(spark, "leaves")
        parts.select("__k", whole.alias("leaf"), F.when(whole, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(whole, F.col("v")).otherwise(F.col("value")).alias("v")).write.parquet(out)
        rows = spark.read.parquet(out)
        found.append(rows.where("leaf"))
        level = rows.where("NOT leaf").select("__k", "path", "v")
        if level.isEmpty():
            break
    schema = F.schema_of_variant("v")
    kind = F.when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.startswith("OBJECT"), "object").otherwise("array")
    leaves = reduce(DataFrame.unionByName, found)
    return leaves.select(F.col("__k").alias(key), "path", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))


def deep_diff(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, change, left_value, right_value`` for each leaf in which JSON texts of equal keys differ.

    ``change`` is ``removed``, ``added``, ``type`` (the kinds differ) or ``changed``. Arrays are compared by position,
    objects by name, numbers by value. A text that only one side has, or that is no JSON on one, differs in all leaves.
    """
    sides = [json_leaves(df, key, text).select(key, "path", F.col("kind").alias(f"{side}_kind"), F.col("value").alias(f"{side}_value")) for df, side in ((left, "left"), (right, "right"))]
    both = sides[0].join(sides[1], [key, "path"], "full_outer")
    number = lambda side: F.when(F.col(f"{side}_kind") == "number", F.col(f"{side}_value").try_cast("double"))
    whole = F.col("left_value").rlike("^-?[0-9]+$") & F.col("right_value").rlike("^-?[0-9]+$")
    equal = F.col("left_value").eqNullSafe(F.col("right_value")) | F.coalesce((number("left") == number("right")) & ~whole, F.lit(False))
    change = F.when(F.col("right_kind").isNull(), "removed").when(F.col("left_kind").isNull(), "added").when(F.col("left_kind") != F.col("right_kind"), "type").when(~equal, "changed")
    return both.select(key, "path", change.alias("change"), "left_value", "right_value").where("change IS NOT NULL")


def metric_mismatch(reported: DataFrame, computed: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Keys whose reported metrics aren't exactly the computed ones."""
    both = reported.alias("r").join(computed.alias("c"), key, "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{m}").eqNullSafe(F.col(f"c.{m}")) for m in metrics))
    return both.where(~same).select(key, *(F.col(f"r.{m}").alias(f"reported_{m}") for m in metrics), *(F.col(f"c.{m}").alias(f"computed_{m}") for m in metrics))


def uniqueness(df: DataFrame, columns: list[str], consistent: list[str]) -> DataFrame:
    """Whether columns are unique, and whether others hold one value."""
    return df.agg(*((F.count(c) == F.count_distinct(c)).alias(f"unique_{c}") for c in columns), *((F.count_distinct(c) <= 1).alias(f"single_{c}") for c in consistent))


def same_shape(left: Column, right: Column) -> Column:
    """Whether two JSON texts have the same structure whatever their scalars."""
    return F.schema_of_variant(F.try_parse_json(left)).eqNullSafe(F.schema_of_variant(F.try_parse_json(right)))


def identifiers_kept(source: Column, target: Column, pattern: str) -> Column:
    """Whether every identifier in the source occurs in the target."""
    return F.forall(F.regexp_extract_all(source, F.lit(pattern), 0), lambda t: F.contains(target, t))


def counts_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they are equal."""
    n = left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(right.agg(F.count(F.lit(1)).alias("right_rows")))
    return n.withColumn("equal", F.col("left_rows") == F.col("right_rows"))


def max_merge(results: list[DataFrame], keys: list[str], score: str) -> DataFrame:
    """Best score of each key over several results."""
    return reduce(DataFrame.unionByName, (r.select(*keys, score) for r in results)).groupBy(*keys).agg(F.max(score).alias(score))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't NULL."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def unfinished(df: DataFrame, final: str) -> DataFrame:
    """Rows whose final text is blank."""
    return df.where(F.coalesce(F.trim(final), F.lit("")) == "")


def fingerprints(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A hash of all rows of a group, in any order.

    Quarters of the rows' hashes are added up, which tasks do before the shuffle; no group's rows meet.
    A repeated row counts each time.
    """
    hashed = df.select(group, content_hash(columns).alias("__h"))
    sums = [F.sum(F.conv(F.substring("__h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).alias(f"__s{k}") for k in range(4)]
    grouped = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return grouped.select(group, "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *(F.col(f"__s{k}").cast("string") for k in range(4))), 256).alias("fingerprint"))
