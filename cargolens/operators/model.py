"""Item-level view and order-level summary.

The reference builds the summary by joining seven tables at item grain and
grouping by 25 columns. Here every order-grain side (orders, customer,
review, payments) is joined once on ``order_id``, and the items are
aggregated by ``order_id`` *before* they meet the orders: the partial
aggregate shrinks the largest table map-side, and the shuffle carries short
integer keys. The result is the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config

ORDER_COLS = (
    "order_id", "order_status", "order_purchase_timestamp", "order_month", "order_week",
    "order_year", "order_quarter", "order_month_num", "order_day_of_week", "order_dow",
    "order_hour", "delivery_days", "delay_days", "is_late", "handling_days",
    "processing_days", "transit_days", "approval_hours", "estimated_delivery_days",
)


def in_window(oc: DataFrame, cfg: Config) -> DataFrame:
    """The analysis window; a literal range on the purchase time, which
    Catalyst pushes down to the scan."""
    ts = F.col("order_purchase_timestamp")
    return oc.where((ts >= F.lit(cfg.window_start).cast("timestamp_ntz"))
                    & (ts < F.lit(cfg.window_end).cast("timestamp_ntz")))


def orders_enriched(oc: DataFrame, customers: DataFrame, rc: DataFrame, pay: DataFrame,
                    cfg: Config) -> DataFrame:
    """Window orders with customer (inner), review and payments (left)."""
    o = in_window(oc, cfg).select(*ORDER_COLS, "customer_id")
    c = customers.select("customer_id", "customer_unique_id", "customer_city",
                         "customer_state", "customer_zip_code_prefix")
    r = rc.select("order_id", "review_score", "has_comment", "review_comment_message")
    p = pay.select("order_id", "primary_payment_type", "primary_installments",
                   "max_installments", "total_payment_value", "payment_count",
                   "is_multi_payment")
    return (o.join(c, "customer_id").drop("customer_id")
            .join(r, "order_id", "left")
            .join(p, "order_id", "left"))


def item_view(items: DataFrame, enriched: DataFrame, pc: DataFrame,
              sellers: DataFrame) -> DataFrame:
    """vw_orders_analysis: one row per item of a window order that has a
    customer. Dimensions join last; AQE broadcasts them when small."""
    i = items.select("order_id", "order_item_id", "product_id", "seller_id", "price",
                     "freight_value")
    prod = pc.select("product_id", "product_category_name", "product_category_english",
                     "product_weight_g", "product_volume_cm3", "product_size_tier",
                     "product_photos_qty", "product_description_length")
    s = sellers.select("seller_id", "seller_city", "seller_state", "seller_zip_code_prefix")
    return (i.join(enriched, "order_id")
            .withColumn("total_item_value", F.col("price") + F.col("freight_value"))
            .join(prod, "product_id", "left")
            .join(s, "seller_id", "left"))


def items_by_order(items: DataFrame) -> DataFrame:
    """Items added up per order, with the number of different products and sellers.

    One chain of three aggregates over one scan: per (order, product), where each product counts once; per
    (order, seller), where each seller does; per order. Every step combines map-side and none needs all lines of an
    order in one task. No row is laid out twice, nothing is joined.
    """
    total = F.col("price") + F.col("freight_value")
    # A product of an order has one seller, seldom more.
    by_product = items.groupBy("order_id", "product_id").agg(
        F.count("order_item_id").alias("n"), F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), F.sum(total).alias("total"),
        F.collect_set("seller_id").alias("sellers"))
    kinds = {c: by_product.schema[c].dataType for c in ("price", "freight", "total")}  # adding up sums must not widen the decimals once more
    amounts = ["n", "price", "freight", "total", "products"]
    each = by_product.withColumn("products", F.col("product_id").isNotNull().cast("long")).select("order_id", *amounts, F.posexplode_outer("sellers").alias("at", "seller_id"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0  # a product's amounts go with its first seller
    by_seller = each.groupBy("order_id", "seller_id").agg(*[F.sum(F.when(first, F.col(c))).alias(c) for c in amounts])
    return by_seller.groupBy("order_id").agg(
        F.sum("n").alias("item_count"), F.sum("products").alias("unique_products"), F.count("seller_id").alias("unique_sellers"),
        *[F.sum(c).cast(kinds[c]).alias(f"order_{name}") for c, name in (("price", "revenue"), ("freight", "freight"), ("total", "total"))])


def amounts_by_order(items: DataFrame) -> DataFrame:
    """items_by_order without the numbers of different products and sellers: one aggregate instead of three."""
    total = F.col("price") + F.col("freight_value")
    return items.groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"), F.sum("price").alias("order_revenue"),
        F.sum("freight_value").alias("order_freight"), F.sum(total).alias("order_total"))


def orders_summary(items: DataFrame, enriched: DataFrame, by_order=items_by_order) -> DataFrame:
    """orders_summary: one row per window order with at least one item.

    ``freight_pct`` is left unrounded (the notebook's form), computed from
    the exact sums. ``by_order`` adds up the items.
    """
    agg = by_order(items)
    s = enriched.drop("review_comment_message").join(agg, "order_id")
    return s.withColumn(
        "freight_pct",
        F.try_divide(F.col("order_freight").cast("double") * 100.0,
                     F.when(F.col("order_revenue") != 0, F.col("order_revenue").cast("double"))))


def orders_summary_check(summary: DataFrame) -> DataFrame:
    from ..functions.exprs import avg_exact, rnd
    return summary.agg(
        F.count(F.lit(1)).alias("total_orders"),
        rnd(avg_exact("order_revenue"), 2).alias("avg_order_value"),
        rnd(F.avg("delivery_days"), 1).alias("avg_delivery_days"),
        rnd(F.avg("review_score"), 2).alias("avg_review_score"),
    )


def delivered(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("delivery_days").isNotNull())


def reviewed(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("review_score").isNotNull())


def reviewed_delivered(summary: DataFrame) -> DataFrame:
    """The notebook's ``rev_del``: scored orders with a delay."""
    return summary.where(F.col("review_score").isNotNull() & F.col("delay_days").isNotNull())
