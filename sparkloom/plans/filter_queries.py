"""The constraint language over orders, events and their JSON properties; record changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import dml
from sparkloom.plans import predicates
from sparkloom.plans.catalog import Tables, query

_OPS = {
    "eq": ({"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "ne": ({"o_orderstatus__ne": "F"}, "o_orderstatus IS DISTINCT FROM 'F'"),
    "gt": ({"o_totalprice__gt": 200000}, "o_totalprice > 200000"),
    "gte": ({"o_custkey__gte": 100}, "o_custkey >= 100"),
    "lt": ({"o_totalprice__lt": 1500.5}, "o_totalprice < 1500.5"),
    "lte": ({"o_orderpriority__lte": "2-HIGH"}, "o_orderpriority <= '2-HIGH'"),
    "contains": ({"o_orderpriority__contains": "I"}, "contains(o_orderpriority, 'I')"),
    "startswith": ({"o_custkey__startswith": 1}, "starts_with(CAST(o_custkey AS VARCHAR), '1')"),
    "endswith": ({"o_orderpriority__endswith": "M"}, "ends_with(o_orderpriority, 'M')"),
    "in": ({"o_orderstatus__in": ["F", "P", None]}, "o_orderstatus IN ('F', 'P')"),
    "nin": ({"o_orderstatus__nin": ["F", "P"]}, "o_orderstatus NOT IN ('F', 'P')"),
    "unknown": ({"o_orderstatus__like": "F"}, "o_orderstatus = 'F'"),
    "mixed_types": ({"o_totalprice__gt": "100", "o_orderkey__gt": 5}, "false"),
    "missing_field": ({"o_absent__ne": "x", "o_orderkey__lt": 100}, "o_orderkey < 100"),
    "conjunction": ({"o_orderstatus": "F", "o_totalprice__gte": 1000, "o_custkey__nin": [1, 2, 3]}, "o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_custkey NOT IN (1, 2, 3)"),
}


def _register(name: str, constraints: dict, where: str) -> None:
    # Counts with a checksum, so that queries whose answer is nobody give a row too.
    sql = f"SELECT count(*) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys FROM orders WHERE {where}"

    @query(f"constraint_filter_{name}", sql)
    def run(t: Tables) -> DataFrame:
        return predicates.query(t.orders, constraints).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0).cast("long")).alias("keys"))


for _name, (_constraints, _where) in _OPS.items():
    _register(_name, _constraints, _where)


@query("constraint_ids", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 7")
def constraint_ids(t: Tables) -> DataFrame:
    """Ids only, with the query's own limit."""
    return predicates.query_json(t.orders, '{"o_orderstatus": "F", "limit": 7, "return_ids": true}', "o_orderkey").select("o_orderkey")


@query("constraint_on_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'view'")
def constraint_on_json(t: Tables) -> DataFrame:
    """Constraints on free-form records."""
    records = predicates.variant_fields(t.events, "props", {"k": "bigint"}, ["event_id", "event_type"])
    return predicates.query(records, {"k__gte": 50, "event_type__ne": "view"}).select("event_id", "k")


@query(
    "record_changes",
    """SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey <> 7 AND c_custkey < 100)
       UNION ALL SELECT -1, 'NEW' """,
)
def record_changes(t: Tables) -> DataFrame:
    """Insert, update and delete, one after another."""
    table = t.customer.select("c_custkey", "c_mktsegment")
    new = t.spark.createDataFrame([(-1, "NEW"), (1, "IGNORED"), (-1, "NEW")], "c_custkey long, c_mktsegment string")
    table, _ = dml.insert_if_absent(table, new, "c_custkey")
    stay, gone = dml.delete_where(table, {"c_mktsegment": "BUILDING", "c_custkey__ne": 7, "c_custkey__lt": 100, "c_custkey__gt": -1})
    return dml.update_by_id(stay, "c_custkey", 7, {"c_mktsegment": "CHANGED"})


@query("deleted_records", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def deleted_records(t: Tables) -> DataFrame:
    return dml.delete_where(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), {"c_mktsegment": "BUILDING", "c_acctbal__lt": 0})[1].drop("c_acctbal")


@query("bulk_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_nationkey ELSE s_name END AS s_name, s_nationkey FROM supplier")
def bulk_update(t: Tables) -> DataFrame:
    """Many field updates in one join."""
    table = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    changes = table.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey")).alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    return dml.update_from(table, changes, "s_suppkey")
