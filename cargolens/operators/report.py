"""Executive KPIs, the KPI table the notebook exports, and the published
output tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, count_when, pct, rnd
from ..sources.sinks import write_csv


def _product_kpis(t) -> DataFrame:
    """Active categories, top category and the Pareto point from one
    per-category frame (a window over categories only)."""
    from pyspark.sql import Window
    cat = t.item_view.groupBy("product_category_english").agg(F.sum("price").alias("rev"))
    w = Window.orderBy(F.desc("rev"), "product_category_english")
    r = cat.select("product_category_english", F.row_number().over(w).cast("long").alias("rank"),
                   F.sum("rev").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                   F.sum("rev").over(Window.partitionBy()).alias("tot"))
    hit = pct(F.col("cum"), F.col("tot")) >= t.cfg.pareto_cut_pct
    return r.agg(F.count(F.lit(1)).alias("active_categories"),
                 F.max(F.when(F.col("rank") == 1, F.col("product_category_english"))).alias("top_category"),
                 F.min(F.when(hit, F.col("rank"))).alias("pareto_categories"))


def _summary_kpis(t) -> DataFrame:
    """Sales, delivery and satisfaction figures: one pass over the order summary,
    each figure over the orders that it speaks of."""
    score, days = F.col("review_score"), F.col("delivery_days")
    delivered = days.isNotNull()
    n_delivered, n_scored = F.count(days), F.count(score)
    return t.orders_summary.agg(
        F.sum("order_revenue").alias("total_revenue"), F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        avg_exact("order_revenue").alias("avg_order_value"),
        F.avg(days).alias("avg_delivery_days"),
        pct(count_when(delivered & F.col("is_late")), n_delivered).alias("late_delivery_rate"),
        F.avg(F.when(delivered, F.col("handling_days"))).alias("avg_handling_days"),
        F.avg(F.when(delivered, F.col("transit_days"))).alias("avg_transit_days"),
        avg_exact("review_score").alias("avg_review_score"),
        pct(count_when(score == 5), n_scored).alias("five_star_rate"),
        pct(count_when(score == 1), n_scored).alias("one_star_rate"))


#: What the figures read of the order summary.
KPI_COLUMNS = ("order_id", "customer_unique_id", "order_revenue", "review_score", "delivery_days", "delay_days", "is_late", "handling_days",
               "transit_days")


def executive_kpis_raw(t, medians: bool = True) -> DataFrame:
    """One row of 17 figures (15 without medians); every part is a one-row aggregate. The order summary is
    computed once: the medians, ranked together, and the rank correlation pass over it again."""
    t = t.measured(*KPI_COLUMNS)
    rho = stats.spearman_raw(t.reviewed_delivered, "order_id", [("delay_days", "review_score")]).select(
        F.col("rho").alias("delay_review_spearman"))
    out = _summary_kpis(t).crossJoin(_product_kpis(t)).crossJoin(rho)
    if not medians:
        return out
    of = {"order_revenue": "median_order_value", "delivery_days": "median_delivery_days"}
    return out.crossJoin(stats.quantile_of_each(t.orders_summary, of, 0.5, t.cfg.exact_percentiles, t.cfg.approx_accuracy))


@query("executive_kpis")
def executive_kpis(t) -> DataFrame:
    """The 17 summary figures: sales, products, delivery, satisfaction."""
    k = executive_kpis_raw(t)
    return k.select(
        rnd("total_revenue", 2).alias("total_revenue"), "total_orders", "unique_customers",
        rnd("avg_order_value", 2).alias("avg_order_value"),
        rnd("median_order_value", 2).alias("median_order_value"), "active_categories", "top_category",
        "pareto_categories", rnd("avg_delivery_days", 2).alias("avg_delivery_days"),
        rnd("median_delivery_days", 2).alias("median_delivery_days"),
        rnd("late_delivery_rate", 2).alias("late_delivery_rate"),
        rnd("avg_handling_days", 2).alias("avg_handling_days"),
        rnd("avg_transit_days", 2).alias("avg_transit_days"),
        rnd("avg_review_score", 3).alias("avg_review_score"),
        rnd("five_star_rate", 2).alias("five_star_rate"), rnd("one_star_rate", 2).alias("one_star_rate"),
        rnd("delay_review_spearman", 4).alias("delay_review_spearman"))


def _fmt(c: str, d: int) -> F.Column:
    """Rounded on a decimal first, then printed with thousands separators."""
    return F.format_number(rnd(c, d), d)


@query("kpi_summary_table")
def kpi_summary_table(t) -> DataFrame:
    """(metric, value) text rows: the exported KPI table, plus the two rows
    the shipped file and the export cell disagree on (SURVEY §1.6o)."""
    k = executive_kpis_raw(t, medians=False)
    rows = [
        ("Total Revenue", F.concat(F.lit("R$ "), _fmt("total_revenue", 2))),
        ("Total Orders", F.format_number(F.col("total_orders"), 0)),
        ("Unique Customers", F.format_number(F.col("unique_customers"), 0)),
        ("Avg Order Value", F.concat(F.lit("R$ "), _fmt("avg_order_value", 2))),
        ("Avg Delivery Days", F.concat(_fmt("avg_delivery_days", 1), F.lit(" days"))),
        ("Late Delivery Rate", F.concat(_fmt("late_delivery_rate", 1), F.lit("%"))),
        ("Avg Review Score", _fmt("avg_review_score", 2)),
        ("5-Star Rate", F.concat(_fmt("five_star_rate", 1), F.lit("%"))),
        ("1-Star Rate", F.concat(_fmt("one_star_rate", 1), F.lit("%"))),
        ("Delay-Review Correlation", F.concat(F.lit("ρ = "), _fmt("delay_review_spearman", 3))),
    ]
    wide = k.select(*[v.alias(f"v{i}") for i, (_, v) in enumerate(rows)])
    pairs = ", ".join(f"'{m}', v{i}" for i, (m, _) in enumerate(rows))
    return wide.selectExpr(f"stack({len(rows)}, {pairs}) as (metric, value)")


def write_processed_tables(t, path: str) -> dict[str, str]:
    """The five published output files, as CSV with headers (small, single
    files): kpi_summary, monthly_trends, category_performance,
    delivery_by_state (late_pct as a fraction), delay_vs_reviews."""
    from ..catalog import QUERIES
    cat = QUERIES["category_performance"](t).drop("avg_review")
    frames = {
        "kpi_summary": QUERIES["kpi_summary_table"](t),
        "monthly_trends": QUERIES["monthly_trend_frame"](t).select(
            "order_month", "revenue", "order_count", "avg_order_value"),
        "category_performance": cat,
        "delivery_by_state": QUERIES["published_delivery_by_state"](t),
        "delay_vs_reviews": QUERIES["delay_buckets8"](t),
    }
    return {k: write_csv(v, os.path.join(path, k), single_file=True) for k, v in frames.items()}
