"""Delivery and logistics (reference category 3, notebook twins, README
figures)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, bands, count_when, ordinal_of, pct, rnd


def _all():  # only over grouped frames
    return Window.partitionBy()


# Fixed values (must equal the reference's): delay bands of the estimate
# accuracy question, as (comparison, label, bound), first match wins.
ACCURACY_BANDS = (("<", "a. 10+ days early", -10), ("<", "b. 5-10 days early", -5),
                  ("<", "c. 1-5 days early", 0), ("<=", "d. On time", 0),
                  ("<=", "e. 1-5 days late", 5), ("<=", "f. 5-10 days late", 10))
ACCURACY_ELSE = "g. 10+ days late"


def band_chain(c: str, edges, otherwise: str) -> F.Column:
    """Searched CASE from (comparison, label, bound) triples; first match wins."""
    return bands(c, edges, otherwise)


def late_pct_of(n: F.Column) -> F.Column:
    return rnd(pct(count_when(F.col("is_late")), n), 1)


@query("delivery_dashboard")
def delivery_dashboard(t) -> DataFrame:
    """Delivered orders: mean/median/p90 delivery days, handling, transit, late share, estimate."""
    d = t.measured("delivery_days", "handling_days", "transit_days", "is_late", "estimated_delivery_days").delivered  # the averages and the two steps of the quantiles pass over it
    base = d.agg(F.count(F.lit(1)).alias("delivered_orders"),
                 rnd(F.avg("delivery_days"), 1).alias("avg_delivery_days"),
                 rnd(F.avg("handling_days"), 1).alias("avg_handling_days"),
                 rnd(F.avg("transit_days"), 1).alias("avg_transit_days"),
                 count_when(F.col("is_late")).alias("late_orders"),
                 late_pct_of(F.count(F.lit(1))).alias("late_pct"),
                 rnd(F.avg("estimated_delivery_days"), 1).alias("avg_estimated_days"))
    q = stats.quantiles(d, "delivery_days", [0.5, 0.9], ["_p50", "_p90"],
                        t.cfg.exact_percentiles, t.cfg.approx_accuracy)
    # Both sides are single rows.
    return base.crossJoin(q).select(
        "delivered_orders", "avg_delivery_days", rnd("_p50", 1).alias("median_delivery"),
        rnd("_p90", 1).alias("p90_delivery"), "avg_handling_days", "avg_transit_days",
        "late_orders", "late_pct", "avg_estimated_days")


@query("delivery_decomposition_monthly")
def delivery_decomposition_monthly(t) -> DataFrame:
    """Per month: handling, transit and total days, late share."""
    n = F.count(F.lit(1))
    return (t.delivered.groupBy("order_month")
            .agg(n.alias("orders"), rnd(F.avg("handling_days"), 1).alias("avg_handling"),
                 rnd(F.avg("transit_days"), 1).alias("avg_transit"),
                 rnd(F.avg("delivery_days"), 1).alias("avg_total"), late_pct_of(n).alias("late_pct"))
            .orderBy("order_month"))


@query("delivery_by_state")
def delivery_by_state(t) -> DataFrame:
    """Customer states with 50+ delivered orders: delivery times, delay, late share, review."""
    n = F.count(F.lit(1))
    g = (t.delivered.groupBy("customer_state")
         .agg(n.alias("orders"), F.avg("delivery_days").alias("_d"),
              rnd(F.avg("handling_days"), 1).alias("avg_handling"),
              rnd(F.avg("transit_days"), 1).alias("avg_transit"),
              rnd(F.avg("delay_days"), 1).alias("avg_delay"), late_pct_of(n).alias("late_pct"),
              rnd(avg_exact("review_score"), 2).alias("avg_review"))
         .where(F.col("orders") >= t.cfg.min_orders_group))
    return g.select("customer_state", "orders", rnd("_d", 1).alias("avg_delivery"), "avg_handling",
                    "avg_transit", "avg_delay", "late_pct", "avg_review"
                    ).orderBy(F.desc("avg_delivery"), "customer_state")


@query("delivery_by_seller_state")
def delivery_by_seller_state(t) -> DataFrame:
    """late_pct is the reference's (late items / distinct orders, can pass
    100); late_order_pct counts late distinct orders (SURVEY §1.6b)."""
    # Once per (state, order) first: counting orders is then counting rows, and
    # a state with most of the items is spread over its orders.
    days = ("handling_days", "transit_days", "delivery_days")
    per_order = (t.item_view.where(F.col("delivery_days").isNotNull()).groupBy("seller_state", "order_id")
                 .agg(count_when(F.col("is_late")).alias("late_items"),
                      *[F.sum(c).alias(c) for c in days], *[F.count(c).alias(f"n_{c}") for c in days]))
    mean = {c: rnd(F.try_divide(F.sum(c), F.sum(f"n_{c}")), 1) for c in days}
    g = (per_order.groupBy("seller_state")
         .agg(F.count(F.lit(1)).alias("orders"), mean["handling_days"].alias("avg_handling"),
              mean["transit_days"].alias("avg_transit"), mean["delivery_days"].alias("avg_delivery"),
              F.sum("late_items").alias("_late_items"),
              count_when(F.col("late_items") > 0).alias("_late_orders"))
         .where(F.col("orders") >= t.cfg.min_orders_group))
    return g.select("seller_state", "orders", "avg_handling", "avg_transit", "avg_delivery",
                    rnd(pct(F.col("_late_items"), F.col("orders")), 1).alias("late_pct"),
                    rnd(pct(F.col("_late_orders"), F.col("orders")), 1).alias("late_order_pct")
                    ).orderBy(F.desc("avg_delivery"), "seller_state")


@query("published_delivery_by_state")
def published_delivery_by_state(t) -> DataFrame:
    """The published delivery_by_state table: states with 50+ deliveries, late_pct as a fraction, unrounded."""
    n = F.count(F.lit(1))
    return (t.delivered.groupBy("customer_state")
            .agg(n.alias("orders"), F.avg("delivery_days").alias("avg_delivery"),
                 (count_when(F.col("is_late")).cast("double") / n).alias("late_pct"))
            .where(F.col("orders") >= t.cfg.min_orders_group)
            .orderBy(F.desc("avg_delivery"), "customer_state"))


def route_type() -> F.Column:
    # NULL seller state is not equal, so it counts as cross state (as the SQL).
    same = F.coalesce(F.col("customer_state") == F.col("seller_state"), F.lit(False))
    return F.when(same, "Same State").otherwise("Cross State")


@query("route_comparison")
def route_comparison(t) -> DataFrame:
    """Same-state vs cross-state items: delivery times, freight, late share, review."""
    n = F.count(F.lit(1))
    return (t.item_view.where(F.col("delivery_days").isNotNull())
            .groupBy(route_type().alias("route_type"))
            .agg(n.alias("items"), rnd(F.avg("delivery_days"), 1).alias("avg_delivery"),
                 rnd(F.avg("handling_days"), 1).alias("avg_handling"),
                 rnd(F.avg("transit_days"), 1).alias("avg_transit"),
                 rnd(avg_exact("freight_value"), 2).alias("avg_freight"),
                 late_pct_of(n).alias("late_pct"),
                 rnd(avg_exact("review_score"), 2).alias("avg_review")))


@query("estimate_accuracy_bands")
def estimate_accuracy_bands(t) -> DataFrame:
    """Scored deliveries by delay band (10/5/0 days): orders, share, review."""
    g = (t.reviewed_delivered
         .groupBy(band_chain("delay_days", ACCURACY_BANDS, ACCURACY_ELSE).alias("delivery_bucket"))
         .agg(F.count(F.lit(1)).alias("orders"), avg_exact("review_score").alias("_r")))
    return g.select("delivery_bucket", "orders",
                    rnd(pct(F.col("orders"), F.sum("orders").over(_all())), 1).alias("pct"),
                    rnd("_r", 2).alias("avg_review")).orderBy("delivery_bucket")


@query("late_root_cause")
def late_root_cause(t) -> DataFrame:
    """Late vs on-time deliveries: handling, transit, total and estimated days."""
    return (t.delivered.groupBy(F.when(F.col("is_late"), "Late").otherwise("On Time").alias("status"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 rnd(F.avg("handling_days"), 1).alias("avg_handling"),
                 rnd(F.avg("transit_days"), 1).alias("avg_transit"),
                 rnd(F.avg("delivery_days"), 1).alias("avg_total"),
                 rnd(F.avg("estimated_delivery_days"), 1).alias("avg_estimated")))


# ---------------------------------------------------------------- notebook --

@query("delivery_histograms")
def delivery_histograms(t) -> DataFrame:
    """50-bin histograms of delivery days and delay days."""
    d, b = t.delivered, t.cfg.delivery_hist_bins
    return stats.histogram(d, "delivery_days", b).unionByName(stats.histogram(d, "delay_days", b))


@query("delivery_stats")
def delivery_stats(t) -> DataFrame:
    """Delivery days: mean, median, standard deviation, p90."""
    d = t.delivered
    m = d.agg(rnd(F.avg("delivery_days"), 4).alias("mean_days"),
              rnd(F.stddev_samp("delivery_days"), 4).alias("std_days"))
    q = stats.quantiles(d, "delivery_days", [0.5, 0.9], ["_m", "_p"], t.cfg.exact_percentiles,
                        t.cfg.approx_accuracy)
    return m.crossJoin(q).select("mean_days", rnd("_m", 4).alias("median_days"), "std_days",
                                 rnd("_p", 4).alias("p90_days"))


@query("late_component_gap")
def late_component_gap(t) -> DataFrame:
    """Mean handling and transit days, late vs on time."""
    return (t.delivered.groupBy(F.when(F.col("is_late"), "Late").otherwise("On Time").alias("status"))
            .agg(rnd(F.avg("handling_days"), 4).alias("avg_handling"),
                 rnd(F.avg("transit_days"), 4).alias("avg_transit")))


def _route_sample(t) -> DataFrame:
    return t.item_view.where(F.col("delivery_days").isNotNull())


@query("mann_whitney_route")
def mann_whitney_route(t) -> DataFrame:
    """U test: do same-state items arrive sooner than cross-state ones?"""
    m = stats.mann_whitney(_route_sample(t), "delivery_days", route_type(), "Same State")
    return m.select("n1", "n2", "u_statistic", rnd("z", 6).alias("z"))


@query("mann_whitney_route_test")
def mann_whitney_route_test(t) -> DataFrame:
    """mann_whitney_route with the one-sided p-value and the 0.001 verdict."""
    m = stats.mann_whitney_test(
        stats.mann_whitney(_route_sample(t), "delivery_days", route_type(), "Same State"))
    return m.select("n1", "n2", "u_statistic", rnd("z", 6).alias("z"), rnd("p_value", 9).alias("p_value"),
                    (F.col("p_value") < 0.001).alias("same_state_faster"))


@query("state_delivery_bands")
def state_delivery_bands(t) -> DataFrame:
    """States with 50+ deliveries: delivery days, late share and its colour band."""
    cfg = t.cfg
    n = F.count(F.lit(1))
    g = (t.delivered.groupBy("customer_state")
         .agg(n.alias("orders"), F.avg("delivery_days").alias("_d"),
              pct(count_when(F.col("is_late")), n).alias("_late"),
              avg_exact("review_score").alias("_r"))
         .where(F.col("orders") >= cfg.min_orders_group))
    band = (F.when(F.col("_late") > cfg.state_late_red_pct, "red (>12% late)")
            .when(F.col("_late") > cfg.state_late_orange_pct, "orange (8-12% late)")
            .otherwise("green (<8% late)"))
    return g.select("customer_state", "orders", rnd("_d", 4).alias("avg_delivery"),
                    rnd("_late", 4).alias("late_pct"), rnd("_r", 4).alias("avg_review"),
                    band.alias("late_band")).orderBy(F.desc("avg_delivery"), "customer_state")


@query("delivery_buffer")
def delivery_buffer(t) -> DataFrame:
    """Mean estimated vs mean actual delivery days, and the gap."""
    d = t.delivered.agg(F.avg("estimated_delivery_days").alias("e"), F.avg("delivery_days").alias("a"))
    return d.select(rnd("e", 4).alias("avg_estimated_days"), rnd("a", 4).alias("avg_actual_days"),
                    rnd(F.col("e") - F.col("a"), 4).alias("buffer_days"))


@query("delivery_buffer_histograms")
def delivery_buffer_histograms(t) -> DataFrame:
    """40-bin histograms of estimated and actual delivery days."""
    d, b = t.delivered, t.cfg.buffer_hist_bins
    return (stats.histogram(d, "estimated_delivery_days", b)
            .unionByName(stats.histogram(d, "delivery_days", b, "actual_delivery_days")))


# ------------------------------------------------------------ README-only --

def _two_quantiles(t, c: str) -> DataFrame:
    s = t.measured(c).orders_summary.where(F.col(c).isNotNull())
    n = s.agg(F.count(F.lit(1)).alias("orders"), rnd(F.avg(c), 4).alias("mean_days"))
    q = stats.quantiles(s, c, [0.5, 0.9], ["_m", "_p"], t.cfg.exact_percentiles,
                        t.cfg.approx_accuracy)
    return n.crossJoin(q).select("orders", "mean_days", rnd("_m", 4).alias("median_days"),
                                 rnd("_p", 4).alias("p90_days"))


@query("processing_time_stats")
def processing_time_stats(t) -> DataFrame:
    """Approval -> carrier hand-off, in days (README figures: median, p90)."""
    return _two_quantiles(t, "processing_days")


@query("transit_time_stats")
def transit_time_stats(t) -> DataFrame:
    """Carrier -> customer days: mean, median, p90."""
    return _two_quantiles(t, "transit_days")


@query("handoff_sla_bands")
def handoff_sla_bands(t) -> DataFrame:
    """Orders by approval -> carrier hours: <=24, <=36, <=48, >48 (edges ours)."""
    h1, h2, h3 = t.cfg.handoff_hours
    hours = F.col("processing_days") * 24.0
    labels = (f"<= {h1}h", f"{h1}-{h2}h", f"{h2}-{h3}h", f"> {h3}h")
    band = (F.when(hours <= h1, labels[0]).when(hours <= h2, labels[1])
            .when(hours <= h3, labels[2]).otherwise(labels[3]))
    g = (t.orders_summary.where(F.col("processing_days").isNotNull())
         .groupBy(band.alias("handoff_band")).agg(F.count(F.lit(1)).alias("orders"),
                                                   count_when(F.col("is_late")).alias("late_orders")))
    return g.select("handoff_band", "orders",
                    rnd(pct(F.col("orders"), F.sum("orders").over(_all())), 1).alias("pct"),
                    "late_orders").orderBy(ordinal_of(F.col("handoff_band"), labels))


@query("cancellation_profile")
def cancellation_profile(t) -> DataFrame:
    """Canceled / unavailable orders in the window, by status and month, with
    the share of that month's orders."""
    o = t.orders_window
    bad = F.col("order_status").isin("canceled", "unavailable")
    month = o.groupBy("order_month").agg(F.count(F.lit(1)).alias("_month_orders"))
    g = o.where(bad).groupBy("order_status", "order_month").agg(F.count(F.lit(1)).alias("orders"))
    return (g.join(month, "order_month")
            .select("order_status", "order_month", "orders",
                    rnd(pct(F.col("orders"), F.col("_month_orders")), 1).alias("pct_of_month"))
            .orderBy("order_status", "order_month"))
