"""Engine relations made from the star schema: records of prices and areas with their attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrences(t) -> DataFrame:
    """A row per appearance of a fact, with its attributes; dimensions are small and left to the optimizer to broadcast."""
    regions = t.region.select("r_regionkey", F.col("r_name").alias("office_id"))
    nations = t.nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), "office_id")
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city", "office_id", F.col("c_mktsegment").alias("neighborhood"))
    orders = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "city", "office_id", "neighborhood", F.col("o_orderpriority").alias("vat_basis"), F.col("o_orderdate").cast("date").alias("valuation_date"))
    parts = t.part.select("p_partkey", F.col("p_type").alias("property_type"), F.col("p_brand").alias("area_type"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").cast("decimal(16,2)").alias("price"), F.col("l_quantity").cast("decimal(12,2)").alias("area"),
        F.col("l_returnflag").alias("data_kind"), F.col("l_linestatus").alias("verification"), F.col("l_shipdate").cast("date").alias("transaction_date"),
    )
    return lines.join(orders, F.col("order_key") == F.col("o_orderkey")).join(parts, F.col("part") == F.col("p_partkey")).drop("o_orderkey", "p_partkey")


def transactions(t) -> DataFrame:
    """A row per fact: its appearances agree on the least (price, area, part, supplier)."""
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.struct(F.col("l_extendedprice").cast("decimal(16,2)").alias("price"), F.col("l_quantity").cast("decimal(12,2)").alias("area"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("v"),
    )
    return lines.groupBy("order_key", "line").agg(F.min("v").alias("v")).select("order_key", "line", "v.price", "v.area")


def versions(t) -> DataFrame:
    """A customer's orders as the numbered versions of one document."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.row_number().over(order).alias("version_no"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"),
    )
