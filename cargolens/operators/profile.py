"""Profiling the raw tables (the reference's inspection script).

The building blocks are generic: any frame, any key, any column list. The
registered queries apply them to the nine raw tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, count_when, month_start, pct, rnd


def _all():  # only over grouped frames
    return Window.partitionBy()


# ------------------------------------------------------------ generic ops --

def row_counts(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    out = None
    for n in names:
        one = tables[n].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def row_col_report(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    out = None
    for n in names:
        one = tables[n].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(n).alias("table_name"), "rows", F.lit(len(tables[n].columns)).alias("cols"))
        out = one if out is None else out.unionByName(one)
    return out


def key_uniqueness(df: DataFrame, key: str, label: str, approx: bool = False) -> DataFrame:
    """count(key), count(distinct key), difference. A single distinct
    aggregate: Spark dedupes (key) in a first shuffle, then counts.
    ``approx`` uses a HyperLogLog sketch instead (no shuffle of keys)."""
    uniq = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return df.agg(F.count(key).alias("total"), uniq.alias("uniq")).select(
        F.lit(label).alias("tbl"), "total", "uniq", (F.col("total") - F.col("uniq")).alias("dups"))


def distinct_count(df: DataFrame, c: str, alias: str, approx: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(c) if approx else F.count_distinct(c)).alias(alias))


def null_counts(df: DataFrame, cols: dict[str, str], total: str | None = "total") -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(total)] if total else []
    aggs += [count_when(F.col(c).isNull()).alias(alias) for c, alias in cols.items()]
    return df.agg(*aggs)


def null_scan(df: DataFrame, table: str) -> DataFrame:
    """Columns with at least one NULL: (table, column, nulls, pct)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[count_when(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot("__n", cols, "column", "nulls")
    return (long.where(F.col("nulls") > 0)
            .select(F.lit(table).alias("table"), "column", "nulls",
                    rnd(pct(F.col("nulls"), F.col("__n")), 1).alias("pct")))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
            desc: str) -> DataFrame:
    """Rows of child whose key has no parent (LEFT JOIN ... IS NULL).

    A NULL child key also counts, as it does in the reference's form."""
    p = parent.select(F.col(parent_key).alias("__k"))
    n = child.join(p, child[child_key] == p["__k"], "left_anti")
    return n.agg(F.count(F.lit(1)).alias("affected_rows")).select(
        F.lit(desc).alias("check_desc"), "affected_rows")


def top_share(df: DataFrame, key: str, count_name: str, k: int) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return (g.select(key, count_name,
                     rnd(pct(F.col(count_name), F.sum(count_name).over(_all())), 1).alias("pct"))
            .orderBy(F.desc(count_name), key).limit(k))


def share_table(df: DataFrame, key: str, count_name: str = "count") -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return g.select(key, count_name,
                    rnd(pct(F.col(count_name), F.sum(count_name).over(_all())), 1).alias("pct"))


RAW_ORDER = ("orders", "order_items", "customers", "payments", "reviews", "products", "sellers",
             "category_translation", "geolocation")


# ---------------------------------------------------------------- queries --

@query("inspect_row_counts")
def inspect_row_counts(t) -> DataFrame:
    """Rows per raw table, largest first."""
    return row_counts(t.raw, RAW_ORDER).orderBy(F.desc("row_count"), "table_name")


@query("row_count_report")
def row_count_report(t) -> DataFrame:
    """Rows x columns of the eight tables the notebook loads."""
    return row_col_report(t.raw, RAW_ORDER[:-1])


@query("inspect_pk_uniqueness")
def inspect_pk_uniqueness(t) -> DataFrame:
    """Total, distinct and duplicate keys of orders, products, sellers, customers."""
    a = t.cfg.approx_key_profiles
    parts = [key_uniqueness(t["orders"], "order_id", "orders", a),
             key_uniqueness(t["products"], "product_id", "products", a),
             key_uniqueness(t["sellers"], "seller_id", "sellers", a),
             key_uniqueness(t["customers"], "customer_id", "customers", a)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("inspect_review_dups")
def inspect_review_dups(t) -> DataFrame:
    """Two distinct counts, each as its own single-distinct aggregate (one
    row each), instead of one aggregate that would expand every row twice."""
    r, a = t["reviews"], t.cfg.approx_key_profiles
    total = r.agg(F.count(F.lit(1)).alias("total_rows"))
    ids = distinct_count(r, "review_id", "unique_review_ids", a)
    orders = distinct_count(r, "order_id", "unique_order_ids", a)
    j = total.crossJoin(ids).crossJoin(orders)  # one-row frames
    return j.select("total_rows", "unique_review_ids", "unique_order_ids",
                    (F.col("total_rows") - F.col("unique_review_ids")).alias("dup_review_ids"),
                    (F.col("total_rows") - F.col("unique_order_ids")).alias("orders_with_multi_reviews"))


@query("inspect_multi_review_orders")
def inspect_multi_review_orders(t) -> DataFrame:
    """Orders with several reviews, widest score spread first (top 10)."""
    g = (t["reviews"].groupBy("order_id")
         .agg(F.count(F.lit(1)).alias("review_count"), F.min("review_score").alias("min_score"),
              F.max("review_score").alias("max_score"))
         .where(F.col("review_count") > 1)
         .withColumn("score_spread", F.col("max_score") - F.col("min_score")))
    return g.orderBy(F.desc("score_spread"), "order_id").limit(t.cfg.top_multi_review_orders)


@query("inspect_customer_identity")
def inspect_customer_identity(t) -> DataFrame:
    """Customer ids vs unique customers and orders per customer."""
    c = t["customers"]
    j = distinct_count(c, "customer_id", "customer_ids").crossJoin(
        distinct_count(c, "customer_unique_id", "unique_customers"))
    return j.select("customer_ids", "unique_customers",
                    rnd(F.try_divide(F.col("customer_ids").cast("double"),
                                     F.col("unique_customers").cast("double")), 2)
                    .alias("orders_per_customer"))


ORDER_NULL_COLS = {"order_id": "null_order_id", "customer_id": "null_customer_id",
                   "order_status": "null_status", "order_purchase_timestamp": "null_purchase_ts",
                   "order_approved_at": "null_approved",
                   "order_delivered_carrier_date": "null_carrier",
                   "order_delivered_customer_date": "null_delivered",
                   "order_estimated_delivery_date": "null_estimated"}


@query("audit_nulls_orders")
def audit_nulls_orders(t) -> DataFrame:
    """NULL count of each order column."""
    return null_counts(t["orders"], ORDER_NULL_COLS)


@query("audit_nulls_by_status")
def audit_nulls_by_status(t) -> DataFrame:
    """Missing dates by order status."""
    n = F.count(F.lit(1))
    nd = count_when(F.col("order_delivered_customer_date").isNull())
    return (t["orders"].groupBy("order_status")
            .agg(n.alias("orders"),
                 count_when(F.col("order_approved_at").isNull()).alias("null_approved"),
                 count_when(F.col("order_delivered_carrier_date").isNull()).alias("null_shipped"),
                 nd.alias("null_delivered"), rnd(pct(nd, n), 1).alias("pct_null_delivered"))
            .orderBy(F.desc("orders"), "order_status"))


@query("audit_delivered_without_date")
def audit_delivered_without_date(t) -> DataFrame:
    """Orders marked delivered with no delivery date."""
    return (t["orders"].where((F.col("order_status") == "delivered")
                              & F.col("order_delivered_customer_date").isNull())
            .select("order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date",
                    "order_estimated_delivery_date"))


@query("audit_nulls_products")
def audit_nulls_products(t) -> DataFrame:
    """NULL count of the product columns."""
    return null_counts(t["products"], {
        "product_category_name": "null_category", "product_name_lenght": "null_name_len",
        "product_description_lenght": "null_desc_len", "product_photos_qty": "null_photos",
        "product_weight_g": "null_weight", "product_length_cm": "null_length"})


@query("audit_review_comments")
def audit_review_comments(t) -> DataFrame:
    """Reviews with a title, with a message, and the comment share."""
    n = F.count(F.lit(1))
    msg = count_when(F.col("review_comment_message").isNotNull())
    return t["reviews"].agg(n.alias("total"),
                            count_when(F.col("review_comment_title").isNotNull()).alias("has_title"),
                            msg.alias("has_message"), rnd(pct(msg, n), 1).alias("pct_with_comment"))


@query("comment_rate_by_score")
def comment_rate_by_score(t) -> DataFrame:
    """Comment share per review score."""
    n = F.count(F.lit(1))
    msg = count_when(F.col("review_comment_message").isNotNull())
    return (t["reviews"].groupBy("review_score")
            .agg(n.alias("total"), msg.alias("has_comment"), rnd(pct(msg, n), 1).alias("pct_commented"))
            .orderBy("review_score"))


def key_presence(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per key per source, in one shuffle: the key columns of every
    source are unioned (narrow), then grouped with map-side combine. A key
    held by a third of the rows is one partial count per task, not a hot
    join partition. NULL keys form their own group (they match nothing)."""
    labels = list(sources)
    parts = [df.select(F.col(key).alias("k"),
                       *[F.lit(1 if lab == label else 0).cast("long").alias(f"n_{lab}")
                         for lab in labels])
             for label, (df, key) in sources.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("k").agg(*[F.sum(f"n_{lab}").alias(f"n_{lab}") for lab in labels])


def orphan_rows(presence: DataFrame, child: str, parent: str) -> F.Column:
    """Child rows whose key has no parent row (LEFT JOIN ... IS NULL)."""
    unmatched = F.col("k").isNull() | (F.col(f"n_{parent}") == 0)
    return F.coalesce(F.sum(F.when(unmatched, F.col(f"n_{child}"))), F.lit(0)).cast("long")


@query("orphan_checks")
def orphan_checks(t) -> DataFrame:
    """The seven foreign-key checks, one grouped pass per key instead of
    seven anti-joins (each table is read once per key it carries)."""
    o, i = t["orders"], t["order_items"]
    by_order = key_presence({"orders": (o, "order_id"), "items": (i, "order_id"),
                             "reviews": (t["reviews"], "order_id"),
                             "payments": (t["payments"], "order_id")})
    by_customer = key_presence({"orders": (o, "customer_id"),
                                "customers": (t["customers"], "customer_id")})
    by_product = key_presence({"items": (i, "product_id"), "products": (t["products"], "product_id")})
    by_seller = key_presence({"items": (i, "seller_id"), "sellers": (t["sellers"], "seller_id")})
    a = by_order.agg(orphan_rows(by_order, "orders", "items").alias("c1"),
                     orphan_rows(by_order, "items", "orders").alias("c2"),
                     orphan_rows(by_order, "orders", "reviews").alias("c6"),
                     orphan_rows(by_order, "orders", "payments").alias("c7"))
    b = by_product.agg(orphan_rows(by_product, "items", "products").alias("c3"))
    c = by_seller.agg(orphan_rows(by_seller, "items", "sellers").alias("c4"))
    d = by_customer.agg(orphan_rows(by_customer, "orders", "customers").alias("c5"))
    wide = a.crossJoin(b).crossJoin(c).crossJoin(d)  # one-row frames
    checks = ["orders→items: orders with no items", "items→orders: items with no order",
              "items→products: items with no product", "items→sellers: items with no seller",
              "orders→customers: orders with no customer", "orders→reviews: orders with no review",
              "orders→payments: orders with no payment"]
    pairs = ", ".join(f"'{d}', c{i}" for i, d in enumerate(checks, start=1))
    return wide.selectExpr(f"stack({len(checks)}, {pairs}) as (check_desc, affected_rows)")


@query("orphan_orders_by_status")
def orphan_orders_by_status(t) -> DataFrame:
    """Orders without items, by status."""
    items = t["order_items"].select("order_id")
    return (t["orders"].join(items, "order_id", "left_anti").groupBy("order_status")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "order_status"))


@query("untranslated_categories")
def untranslated_categories(t) -> DataFrame:
    """Product categories missing from the raw translation table (before
    the fix); one grouped pass instead of DISTINCT over a window."""
    tr = t["category_translation"].select("product_category_name")
    return (t["products"].where(F.col("product_category_name").isNotNull())
            .join(tr, "product_category_name", "left_anti")
            .groupBy(F.col("product_category_name").alias("missing_category"))
            .agg(F.count(F.lit(1)).alias("product_count"))
            .orderBy(F.desc("product_count"), "missing_category"))


@query("category_coverage_gap")
def category_coverage_gap(t) -> DataFrame:
    """Distinct categories either side. A full outer join keeps each side's
    non-NULL keys as they are, so the counts need no join at all."""
    a = distinct_count(t["products"], "product_category_name", "categories_in_products")
    b = distinct_count(t["category_translation"], "product_category_name",
                       "categories_in_translation")
    return a.crossJoin(b).withColumn(
        "gap", F.col("categories_in_products") - F.col("categories_in_translation"))


@query("order_date_range")
def order_date_range(t) -> DataFrame:
    """First and last purchase and the span in days."""
    g = t["orders"].agg(F.min("order_purchase_timestamp").alias("first_order"),
                        F.max("order_purchase_timestamp").alias("last_order"))
    return g.withColumn("span_days", F.datediff(F.col("last_order").cast("date"),
                                                F.col("first_order").cast("date")))


@query("monthly_volume_cancel_rate")
def monthly_volume_cancel_rate(t) -> DataFrame:
    """Orders and cancellation share per month (all orders)."""
    n = F.count(F.lit(1))
    return (t["orders"].groupBy(month_start("order_purchase_timestamp").alias("month"))
            .agg(n.alias("orders"),
                 rnd(pct(count_when(F.col("order_status") == "canceled"), n), 1).alias("cancel_rate_pct"))
            .orderBy("month"))


@query("hourly_volume_raw")
def hourly_volume_raw(t) -> DataFrame:
    """Orders per hour of day (all orders)."""
    return (t["orders"].groupBy(F.hour("order_purchase_timestamp").alias("hour_of_day"))
            .agg(F.count(F.lit(1)).alias("orders")).orderBy("hour_of_day"))


PRICE_PROBS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)
PRICE_NAMES = ("p10", "p25", "median", "p75", "p90", "p99")


@query("price_distribution")
def price_distribution(t) -> DataFrame:
    """Item price: count, min, p10-p99, max, mean, standard deviation."""
    i = t["order_items"]
    base = i.agg(F.count(F.lit(1)).alias("items"), F.min("price").cast("double").alias("min_price"),
                 F.max("price").cast("double").alias("max_price"),
                 rnd(avg_exact("price"), 2).alias("mean_price"),
                 rnd(F.stddev_samp(F.col("price").cast("double")), 2).alias("std_price"))
    q = stats.quantiles(i, "price", PRICE_PROBS, [f"_{n}" for n in PRICE_NAMES],
                        t.cfg.exact_percentiles, t.cfg.approx_accuracy)
    return base.crossJoin(q).select(
        "items", "min_price", *[rnd(f"_{n}", 4).alias(n) for n in PRICE_NAMES],
        "max_price", "mean_price", "std_price")


@query("freight_distribution")
def freight_distribution(t) -> DataFrame:
    """Item freight: min, median, p90, p99, max, mean, zero-freight items."""
    i = t["order_items"]
    base = i.agg(F.min("freight_value").cast("double").alias("min_freight"),
                 F.max("freight_value").cast("double").alias("max_freight"),
                 rnd(avg_exact("freight_value"), 2).alias("mean_freight"),
                 count_when(F.col("freight_value") == 0).alias("zero_freight_items"))
    q = stats.quantiles(i, "freight_value", (0.5, 0.9, 0.99), ["_m", "_p90", "_p99"],
                        t.cfg.exact_percentiles, t.cfg.approx_accuracy)
    return base.crossJoin(q).select("min_freight", rnd("_m", 4).alias("median_freight"),
                                    rnd("_p90", 4).alias("p90_freight"),
                                    rnd("_p99", 4).alias("p99_freight"), "max_freight",
                                    "mean_freight", "zero_freight_items")


@query("items_per_order_dist")
def items_per_order_dist(t) -> DataFrame:
    """Orders by number of items, with shares."""
    per = t["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("items_per_order"))
    return share_table(per, "items_per_order", "order_count").orderBy("items_per_order")


@query("payment_profile")
def payment_profile(t) -> DataFrame:
    """Per payment type: count, zero values, zero installments, min/max/mean value."""
    return (t["payments"].groupBy("payment_type")
            .agg(F.count(F.lit(1)).alias("count"),
                 count_when(F.col("payment_value") == 0).alias("zero_value"),
                 count_when(F.col("payment_installments") == 0).alias("zero_installments"),
                 F.min("payment_value").cast("double").alias("min_val"),
                 F.max("payment_value").cast("double").alias("max_val"),
                 rnd(avg_exact("payment_value"), 2).alias("avg_val"))
            .orderBy(F.desc("count"), "payment_type"))


@query("review_score_dist_raw")
def review_score_dist_raw(t) -> DataFrame:
    """Raw reviews per score: count, share, cumulative count."""
    s = share_table(t["reviews"], "review_score")
    # RANGE frame over the (five-row) grouped frame, as SUM(COUNT(*)) OVER (ORDER BY ...).
    return s.withColumn("cumulative", F.sum("count").over(Window.orderBy("review_score"))
                        ).orderBy("review_score")


@query("order_status_dist")
def order_status_dist(t) -> DataFrame:
    """Orders per status, with shares."""
    return share_table(t["orders"], "order_status").orderBy(F.desc("count"), "order_status")


@query("customer_state_concentration")
def customer_state_concentration(t) -> DataFrame:
    """Top 10 customer states by customers, with shares."""
    return top_share(t["customers"], "customer_state", "customers", t.cfg.top_states)


@query("seller_state_concentration")
def seller_state_concentration(t) -> DataFrame:
    """Top 10 seller states by sellers, with shares."""
    return top_share(t["sellers"], "seller_state", "sellers", t.cfg.top_states)


@query("geo_points_per_zip")
def geo_points_per_zip(t) -> DataFrame:
    """Geolocation points, zip prefixes and points per prefix."""
    g = t["geolocation"]
    j = g.agg(F.count(F.lit(1)).alias("total_points")).crossJoin(
        distinct_count(g, "geolocation_zip_code_prefix", "unique_zips"))
    return j.select("total_points", "unique_zips",
                    rnd(F.try_divide(F.col("total_points").cast("double"),
                                     F.col("unique_zips").cast("double")), 1).alias("avg_points_per_zip"))


@query("null_scan")
def null_scan_query(t) -> DataFrame:
    """Columns with NULLs in six raw tables, with counts and shares."""
    out = None
    for n in ("orders", "order_items", "customers", "payments", "reviews", "products"):
        one = null_scan(t[n], n)
        out = one if out is None else out.unionByName(one)
    return out
