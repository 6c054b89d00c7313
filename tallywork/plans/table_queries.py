"""Snapshot tables: DDL and DML with the SELECT that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.operators.order import numbered
from tallywork.operators.table import Constraints, Table
from tallywork.plans.catalogue import register, table


@register(
    "dml_update_delete_snapshot",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal,
    s_nationkey AS home FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)""",
)
def dml_update_delete_snapshot(spark, d):
    t = Table.of("supplier", table(spark, d, "supplier"), Constraints(not_null=("s_name",), primary_key="s_suppkey"))
    t.delete(F.col("s_acctbal") < 0)
    t.update({"s_name": F.lit("renamed"), "s_acctbal": F.col("s_acctbal") * 2}, F.col("s_suppkey") % 5 == 0)
    t.rename_column("s_nationkey", "home")
    return t.commit().rows.select("s_suppkey", "s_name", "s_acctbal", "home")


@register(
    "dml_insert_autoid",
    "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + i, n, CAST(NULL AS VARCHAR) FROM (VALUES (1, 'first'), (2, 'second'), (3, NULL)) v(i, n)",
)
def dml_insert_autoid(spark, d):
    t = Table.of("region", table(spark, d, "region"), Constraints(primary_key="r_regionkey", autoincrement=True))
    t.add_column("note", "string").insert([("first",), ("second",)], ["r_name"]).insert([(None,)], ["r_name"])
    return t.commit().rows


@register("dml_revert", "SELECT n_nationkey, n_name FROM nation")
def dml_revert(spark, d):
    t = Table.of("nation", table(spark, d, "nation").select("n_nationkey", "n_name"))
    t.delete().revert()
    return t.rows


@register("dml_delete_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders WHERE o_orderstatus <> 'O'")
def dml_delete_nulls(spark, d):
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    t = Table.of("orders", table(spark, d, "orders").select("o_orderkey", status.alias("status")))
    return t.delete(F.col("status").isNull()).commit().rows


@register("ddl_columns", "SELECT p_partkey, p_name AS label, CAST(NULL AS DOUBLE) AS height FROM part")
def ddl_columns(spark, d):
    t = Table.of("part", table(spark, d, "part").select("p_partkey", "p_name", "p_size"))
    t.add_column("new", "double").rename_column("new", "height").drop_column("p_size").rename_column("p_name", "label")
    return t.commit().rows.select("p_partkey", "label", "height")


@register("like_update", "SELECT n_nationkey, CASE WHEN n_name LIKE 'N%' THEN 'starts with N' ELSE n_name END AS n_name FROM nation")
def like_update(spark, d):
    t = Table.of("nation", table(spark, d, "nation").select("n_nationkey", "n_name"))
    return t.update({"n_name": F.lit("starts with N")}, F.col("n_name").startswith("N")).commit().rows


@register("param_lookup", "SELECT p_partkey AS item_id, p_name AS name, CAST(NULL AS VARCHAR) AS q FROM part WHERE p_partkey = 7")
def param_lookup(spark, d):
    parts = table(spark, d, "part")
    return spark.sql("SELECT p_partkey AS item_id, p_name AS name, CAST(:q AS STRING) AS q FROM {parts} WHERE p_partkey = :id", args={"id": 7, "q": None}, parts=parts)


@register("order_by_name_desc", "SELECT row_number() OVER (ORDER BY n_name DESC) - 1 AS place, n_name FROM nation ORDER BY n_name DESC")
def order_by_name_desc(spark, d):
    return numbered(table(spark, d, "nation").select("n_name"), F.desc("n_name"), name="place", first=0).select("place", "n_name").orderBy(F.desc("n_name"))
