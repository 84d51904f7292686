"""Star schema the README describes: two facts and five dimensions.

The README names the tables only, so the columns are ours. Facts are
partitioned by month when written, so month filters prune files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.exprs import rnd
from ..sources.sinks import write_table
from .geo import item_distances


@query("fact_deliveries")
def fact_deliveries(t) -> DataFrame:
    """One row per delivered order of the window."""
    return t.delivered.select(
        "order_id", "customer_unique_id", F.col("order_purchase_timestamp").cast("date").alias("date_key"),
        "order_month", "customer_state", "delivery_days", "handling_days", "processing_days",
        "transit_days", "delay_days", "estimated_delivery_days", "is_late", "review_score",
        "item_count", F.col("order_revenue").cast("double").alias("order_revenue"),
        F.col("order_freight").cast("double").alias("order_freight"))


@query("fact_order_economics")
def fact_order_economics(t) -> DataFrame:
    """One row per order line, with its corridor distance."""
    d = item_distances(t)
    return d.select(
        "order_id", "order_item_id", "product_id", "seller_id", "customer_unique_id",
        F.col("order_purchase_timestamp").cast("date").alias("date_key"), "order_month",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        F.col("total_item_value").cast("double").alias("total_item_value"),
        F.when(F.col("price") > 0, F.col("freight_value").cast("double") * 100.0
               / F.col("price").cast("double")).alias("freight_pct"),
        rnd("distance_km", 3).alias("distance_km"))


@query("dim_seller")
def dim_seller(t) -> DataFrame:
    """Seller dimension with zip centroid."""
    g = t.geolocation_clean.select(F.col("geolocation_zip_code_prefix").alias("seller_zip_code_prefix"),
                                   F.col("avg_lat").alias("lat"), F.col("avg_lng").alias("lng"))
    return t["sellers"].join(g, "seller_zip_code_prefix", "left").select(
        "seller_id", "seller_city", "seller_state", "seller_zip_code_prefix", "lat", "lng")


@query("dim_customer")
def dim_customer(t) -> DataFrame:
    """One row per person: attributes of their latest order, order count,
    first and last purchase (raw customers and orders, all time)."""
    o = t["orders"].select("customer_id", "order_id", "order_purchase_timestamp")
    c = t["customers"].join(o, "customer_id")
    key = F.struct(F.col("order_purchase_timestamp"), F.col("order_id"))
    return c.groupBy("customer_unique_id").agg(
        F.max_by("customer_city", key).alias("customer_city"),
        F.max_by("customer_state", key).alias("customer_state"),
        F.max_by("customer_zip_code_prefix", key).alias("customer_zip_code_prefix"),
        F.count(F.lit(1)).alias("orders"),
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"))


@query("dim_product")
def dim_product(t) -> DataFrame:
    """Product dimension: the cleaned products, and how often each was sold (all time)."""
    sold = t["order_items"].groupBy("product_id").agg(F.count(F.lit(1)).alias("items_sold"))
    return t.products_clean.join(sold, "product_id", "left").withColumn(
        "items_sold", F.coalesce("items_sold", F.lit(0)))


@query("dim_date")
def dim_date(t) -> DataFrame:
    """Every day from the first to the last purchase. The span is bounded by
    the calendar (a few thousand days), so one row exploding it is fine."""
    r = t["orders"].agg(F.min("order_purchase_timestamp").cast("date").alias("lo"),
                        F.max("order_purchase_timestamp").cast("date").alias("hi"))
    d = r.select(F.explode(F.sequence("lo", "hi")).alias("date_key"))
    return d.select("date_key", F.year("date_key").alias("year"), F.quarter("date_key").alias("quarter"),
                    F.month("date_key").alias("month"),
                    F.trunc("date_key", "month").alias("month_start"),
                    (F.dayofweek("date_key") - 1).alias("day_of_week"),
                    F.date_format("date_key", "EEEE").alias("day_name"),
                    F.dayofweek("date_key").isin(1, 7).alias("is_weekend"))


@query("dim_geography")
def dim_geography(t) -> DataFrame:
    """Zip-prefix dimension: centroid, modal city and state, sellers and customers there."""
    key = "geolocation_zip_code_prefix"
    g = t.geolocation_clean
    for table, zip_, name in (("sellers", "seller_zip_code_prefix", "sellers"),
                              ("customers", "customer_zip_code_prefix", "customers")):
        n = t[table].groupBy(F.col(zip_).alias(key)).agg(F.count(F.lit(1)).alias(name))
        g = g.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return g


STAR = ("fact_deliveries", "fact_order_economics", "dim_seller", "dim_customer", "dim_product",
        "dim_date", "dim_geography")


def build_star_schema(t, path: str) -> dict[str, str]:
    """Write the seven tables as Parquet under ``path``."""
    from ..catalog import QUERIES
    out = {}
    for name in STAR:
        part = ("order_month",) if name.startswith("fact_") else ()
        out[name] = write_table(QUERIES[name](t), os.path.join(path, name), partition_by=part,
                                cluster_by=("order_id",) if part else ())
    return out
