"""Point lookups and small multi-table reads of record stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.windows import leading_run
from sparkloom.plans.predicates import query


def by_key(df: DataFrame, key: str, value: object, require: bool = False) -> DataFrame:
    """The row of a key; with ``require`` none raises."""
    found = df.where(F.col(key) == F.lit(value))
    if require and found.isEmpty():
        raise ValueError(f"no {key} {value!r}")
    return found


def by_text(df: DataFrame, values: dict[str, str], order: str | None = None) -> DataFrame:
    """Rows whose texts equal the given, case aside; the first by order, or all."""
    found = df
    for name, value in values.items():
        found = found.where(F.lower(name) == value.lower())
    return found.orderBy(order).limit(1) if order else found


def in_map(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose map has a key, with its value."""
    return df.where(F.map_contains_key(column, F.lit(key))).withColumn("found", F.try_element_at(column, F.lit(key)))


def variant_owner(df: DataFrame, key: str, column: str, variant: str) -> DataFrame:
    """The row that holds a variant, and the variant."""
    return df.select(key, F.explode(column).alias("variant_id", "variant")).where(F.col("variant_id") == variant)


def direct_flights(flights: DataFrame, day: str, origin: str | None = None, destination: str | None = None, after: str | None = None) -> DataFrame:
    """Flights available on a day (F17, L04); times of day compare as texts."""
    status = F.try_element_at("dates", F.lit(day))
    found = flights.where(status["status"] == "available").withColumn("day", status)
    for column, value in (("origin", origin), ("destination", destination)):
        found = found.where(F.col(column) == value) if value is not None else found
    return found.where(F.col("departs") >= after) if after is not None else found


def next_day(day: Column, arrives: Column) -> Column:
    """The day that a leg ends on: one later if its arrival ends with ``+1``."""
    return F.when(F.endswith(arrives, F.lit("+1")), F.date_format(F.date_add(F.to_date(day), 1), "yyyy-MM-dd")).otherwise(day)


def ids_of(df: DataFrame, ids: str, other: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows that an array of ids names, sorted and limited."""
    return df.select(F.explode(ids).alias(key)).join(other, key).orderBy(*order).limit(limit)


def by_any_phone(customers: DataFrame, lines: DataFrame, phone: str, order: str) -> DataFrame:
    """The first customer whose own or any of whose lines' number it is."""
    own = customers.where(F.col("phone_number") == phone).select("customer_id")
    owned = customers.select("customer_id", F.explode("line_ids").alias("line_id")).join(lines.where(F.col("phone_number") == phone), "line_id").select("customer_id")
    return customers.join(own.union(owned).distinct(), "customer_id", "left_semi").orderBy(order).limit(1)


def billing_end(start: Column) -> Column:
    """A cycle's end a month on; from December it keeps the year, as the records have it."""
    return F.when(F.month(start) == 12, F.make_date(F.year(start), F.lit(1), F.dayofmonth(start))).otherwise(F.add_months(start, 1))


def on_time_streak(payments: DataFrame, user: str, day: str, status: str, latest: int = 12) -> DataFrame:
    """How many of the latest payments in a row were on time (L14, W06); dates compare as texts."""
    return leading_run(payments, [user], [F.desc(day)], F.col(status) == "ON_TIME", latest)


def everything_of(tables: dict[str, DataFrame], key: str, value: object) -> DataFrame:
    """All records of one owner, as JSON, from several tables."""
    parts = [df.where(F.col(key) == value).select(F.lit(name).alias("source"), F.to_json(F.struct(*df.columns)).alias("record")) for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_field(df: DataFrame, field: str, value: object) -> DataFrame:
    """All records whose field equals a value (L12, L13), by the rules of constraints."""
    return query(df, {field: value})


def every_record(df: DataFrame, id_col: str) -> DataFrame:
    """All records of a table, by id."""
    return df.orderBy(id_col)
