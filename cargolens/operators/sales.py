"""Sales and revenue trends (reference category 1, and the notebook's twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, pct, rnd

# Day names by EXTRACT(DOW) number (0 = Sunday).
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# A window with no partitioning pulls rows into one task; every such window
# in this package runs over an already grouped, small frame (a handful of
# payment types, states, segments), never over raw rows.
def _all():
    return Window.partitionBy()


def share_of_total(c: str) -> F.Column:
    return rnd(pct(F.col(c), F.sum(c).over(_all())), 1)


@query("monthly_sales")
def monthly_sales(t) -> DataFrame:
    """Per month: orders, revenue, freight, GMV, average order value, items per order."""
    # One row per order in the summary, so COUNT(DISTINCT order_id) is a count.
    return (t.orders_summary.groupBy("order_month")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 rnd(F.sum("order_revenue"), 2).alias("total_revenue"),
                 rnd(F.sum("order_freight"), 2).alias("total_freight"),
                 rnd(F.sum("order_total"), 2).alias("total_gmv"),
                 rnd(avg_exact("order_revenue"), 2).alias("avg_order_value"),
                 rnd(avg_exact("item_count"), 1).alias("avg_items_per_order"))
            .orderBy("order_month"))


@query("yoy_growth")
def yoy_growth(t) -> DataFrame:
    """Months 1-8 of the current year against the previous one.

    Grouped by year first (one distinct count per year), then the two rows
    are turned into columns by conditional aggregates over a 2-row frame.
    """
    cfg = t.cfg
    cur, prev = cfg.yoy_current_year, cfg.yoy_previous_year
    s = t.orders_summary.where(F.col("order_month_num").between(1, cfg.yoy_last_month)
                               & F.col("order_year").isin(cur, prev))
    y = s.groupBy("order_year").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        avg_exact("order_revenue").alias("aov"),
        F.count_distinct("customer_unique_id").alias("customers"))

    def pick(c, year):
        return F.max(F.when(F.col("order_year") == year, F.col(c)))

    w = y.agg(*[pick(c, yr).alias(f"{c}_{tag}") for c in ("orders", "revenue", "aov", "customers")
                for yr, tag in ((cur, "c"), (prev, "p"))])
    growth = lambda c: rnd(pct(F.col(f"{c}_c") - F.col(f"{c}_p"), F.col(f"{c}_p")), 1)
    return w.where(F.col("orders_c").isNotNull() & F.col("orders_p").isNotNull()).select(
        F.col("orders_c").alias(f"orders_{cur}"),
        F.col("orders_p").alias(f"orders_{prev}"),
        growth("orders").alias("order_growth_pct"),
        rnd("revenue_c", 2).alias(f"revenue_{cur}"),
        rnd("revenue_p", 2).alias(f"revenue_{prev}"),
        growth("revenue").alias("revenue_growth_pct"),
        rnd("aov_c", 2).alias(f"aov_{cur}"),
        rnd("aov_p", 2).alias(f"aov_{prev}"),
        F.col("customers_c").alias(f"customers_{cur}"),
        F.col("customers_p").alias(f"customers_{prev}"),
        growth("customers").alias("customer_growth_pct"),
    )


@query("yoy_growth_unrounded")
def yoy_growth_unrounded(t) -> DataFrame:
    """The notebook's year on year: same figures, no rounding (money exact)."""
    cfg = t.cfg
    cur, prev = cfg.yoy_current_year, cfg.yoy_previous_year
    s = t.orders_summary.where(F.col("order_month_num").between(1, cfg.yoy_last_month)
                               & F.col("order_year").isin(cur, prev))
    y = s.groupBy("order_year").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_revenue").alias("revenue"),
        avg_exact("order_revenue").alias("aov"),
        F.count_distinct("customer_unique_id").alias("customers"))
    return y.select("order_year", "orders", F.col("revenue").cast("double").alias("revenue"),
                    "aov", "customers").orderBy("order_year")


@query("revenue_by_payment_type")
def revenue_by_payment_type(t) -> DataFrame:
    """Per primary payment type: orders, share of orders, value, averages."""
    g = (t.orders_summary.where(F.col("primary_payment_type").isNotNull())
         .groupBy("primary_payment_type")
         .agg(F.count(F.lit(1)).alias("order_count"),
              F.sum("order_total").alias("_total"),
              avg_exact("order_total").alias("_avg_total"),
              avg_exact("order_revenue").alias("_avg_rev")))
    return g.select(
        "primary_payment_type", "order_count",
        share_of_total("order_count").alias("pct_orders"),
        rnd("_total", 2).alias("total_value"),
        rnd("_avg_total", 2).alias("avg_value"),
        rnd("_avg_rev", 2).alias("avg_revenue"),
    ).orderBy(F.desc("total_value"))


@query("installment_behavior")
def installment_behavior(t) -> DataFrame:
    """Credit-card orders by installments 1-12: orders, order value, review."""
    return (t.orders_summary
            .where((F.col("primary_payment_type") == "credit_card")
                   & F.col("max_installments").between(1, 12))
            .groupBy(F.col("max_installments").alias("installments"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 rnd(avg_exact("order_revenue"), 2).alias("avg_order_value"),
                 rnd(avg_exact("order_total"), 2).alias("avg_total"),
                 rnd(avg_exact("review_score"), 2).alias("avg_review_score"))
            .orderBy("installments"))


def day_name(c: str) -> F.Column:
    expr = None
    for i, name in enumerate(DAY_NAMES):
        cond = F.col(c) == i
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


@query("sales_by_weekday")
def sales_by_weekday(t) -> DataFrame:
    """Per day of week (0 = Sunday): orders, revenue, average order value."""
    return (t.orders_summary.groupBy("order_day_of_week")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 rnd(F.sum("order_revenue"), 2).alias("total_revenue"),
                 rnd(avg_exact("order_revenue"), 2).alias("avg_order_value"))
            .select("order_day_of_week", day_name("order_day_of_week").alias("day_name"),
                    "order_count", "total_revenue", "avg_order_value")
            .orderBy("order_day_of_week"))


@query("sales_by_hour")
def sales_by_hour(t) -> DataFrame:
    """Per hour of purchase: orders and revenue."""
    return (t.orders_summary.groupBy("order_hour")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 rnd(F.sum("order_revenue"), 2).alias("revenue"))
            .orderBy("order_hour"))


@query("top_states_by_revenue")
def top_states_by_revenue(t) -> DataFrame:
    """Top customer states by revenue; the order share is over all states."""
    g = (t.orders_summary.groupBy("customer_state")
         .agg(F.count(F.lit(1)).alias("orders"),
              F.count_distinct("customer_unique_id").alias("unique_customers"),
              F.sum("order_revenue").alias("_rev"),
              avg_exact("order_revenue").alias("_aov")))
    # The share is taken over all states, before the top-k cut.
    return (g.select("customer_state", "orders", "unique_customers",
                     rnd("_rev", 2).alias("total_revenue"), rnd("_aov", 2).alias("avg_order_value"),
                     share_of_total("orders").alias("pct_orders"), "_rev")
            .orderBy(F.desc("_rev"), "customer_state").limit(t.cfg.top_states).drop("_rev"))


def customer_orders(t) -> DataFrame:
    return (t.orders_summary.groupBy("customer_unique_id")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("order_revenue").alias("lifetime_revenue"),
                 F.min("order_purchase_timestamp").alias("first_order"),
                 F.max("order_purchase_timestamp").alias("last_order")))


@query("repeat_customer_segments")
def repeat_customer_segments(t) -> DataFrame:
    """Customers by order count (1, 2, 3, 4+): share, lifetime value, revenue share."""
    n = F.col("order_count")
    seg = (F.when(n == 1, "1 order").when(n == 2, "2 orders").when(n == 3, "3 orders")
           .otherwise("4+ orders"))
    g = (customer_orders(t).groupBy(seg.alias("customer_segment"))
         .agg(F.count(F.lit(1)).alias("customers"),
              avg_exact("lifetime_revenue").alias("_ltv"),
              F.sum("lifetime_revenue").alias("_rev"),
              F.min("order_count").alias("_min")))
    return g.select(
        "customer_segment", "customers",
        share_of_total("customers").alias("pct_customers"),
        rnd("_ltv", 2).alias("avg_ltv"),
        rnd("_rev", 2).alias("total_revenue"),
        rnd(pct(F.col("_rev"), F.sum("_rev").over(_all())), 1).alias("pct_revenue"),
        "_min",
    ).orderBy("_min").drop("_min")


# ---------------------------------------------------------------- notebook --

@query("monthly_trend_frame")
def monthly_trend_frame(t) -> DataFrame:
    """The published monthly_trends table (plus freight), unrounded."""
    return (t.orders_summary.groupBy("order_month")
            .agg(F.sum("order_revenue").cast("double").alias("revenue"),
                 F.count(F.lit(1)).alias("order_count"),
                 avg_exact("order_revenue").alias("avg_order_value"),
                 F.sum("order_freight").cast("double").alias("freight"))
            .orderBy("order_month"))


def monthly_aov_indexed(t) -> DataFrame:
    m = t.orders_summary.groupBy("order_month").agg(avg_exact("order_revenue").alias("aov"))
    # 20-ish rows: a global ordering window is fine here.
    return m.withColumn("month_index",
                        (F.row_number().over(Window.orderBy("order_month")) - 1).cast("double"))


@query("aov_trend_regression")
def aov_trend_regression(t) -> DataFrame:
    """OLS of monthly AOV on the month index 0..n-1 (scipy linregress)."""
    return stats.ols(monthly_aov_indexed(t), "month_index", "aov")


@query("aov_trend_significance")
def aov_trend_significance(t) -> DataFrame:
    """The regression's two-sided p-value (t test, n-2 df) and 5 % verdict."""
    return stats.ols_test(stats.ols_raw(monthly_aov_indexed(t), "month_index", "aov"))


@query("payment_share")
def payment_share(t) -> DataFrame:
    """Order total by primary payment type and its share (the pie chart's data)."""
    g = (t.orders_summary.where(F.col("primary_payment_type").isNotNull())
         .groupBy("primary_payment_type").agg(F.sum("order_total").alias("_v")))
    return g.select("primary_payment_type", rnd("_v", 2).alias("total_value"),
                    rnd(pct(F.col("_v"), F.sum("_v").over(_all())), 1).alias("share_pct")
                    ).orderBy(F.desc("total_value"))


@query("installment_spearman")
def installment_spearman(t) -> DataFrame:
    """Credit-card orders: rank correlation of the primary payment's
    installments with order revenue, over all installment counts."""
    cc = t.orders_summary.where(F.col("primary_payment_type") == "credit_card")
    return stats.spearman(cc, "order_id", [("primary_installments", "order_revenue")])


@query("installment_spearman_test")
def installment_spearman_test(t) -> DataFrame:
    """installment_spearman with its two-sided p-value."""
    cc = t.orders_summary.where(F.col("primary_payment_type") == "credit_card")
    return stats.spearman_test(stats.spearman_raw(cc, "order_id", [("primary_installments", "order_revenue")]))


@query("repeat_customers")
def repeat_customers(t) -> DataFrame:
    """The notebook's segment figures beyond the SQL table: customers and the
    repeat purchase rate."""
    c = customer_orders(t)
    return c.agg(F.count(F.lit(1)).alias("total_customers"),
                 F.count_if(F.col("order_count") > 1).alias("repeat_customers"),
                 rnd(pct(F.count_if(F.col("order_count") > 1), F.count(F.lit(1))), 1)
                 .alias("repeat_rate_pct"))


@query("peak_hour")
def peak_hour(t) -> DataFrame:
    """The hour with most orders (ties to the earlier hour)."""
    h = t.orders_summary.groupBy("order_hour").agg(F.count(F.lit(1)).alias("orders"))
    key = F.struct(F.col("orders"), -F.col("order_hour"))
    return h.agg(F.max_by("order_hour", key).alias("peak_hour"),
                 F.max("orders").alias("peak_orders"))
