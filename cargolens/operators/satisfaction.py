"""Customer satisfaction (reference category 4, and the notebook's twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, count_when, ordinal_of, pct, right_closed_bins, rnd
from .delivery import band_chain


def _all():  # only over grouped frames
    return Window.partitionBy()


# Fixed values (must equal the reference's): the delay bands and labels of
# the review questions, and the notebook's right-closed bins and labels.
DELAY_BANDS = (("<", "a. 7+ days early", -7), ("<", "b. 3-7 days early", -3),
               ("<", "c. 1-3 days early", 0), ("<=", "d. On time", 0),
               ("<=", "e. 1-3 days late", 3), ("<=", "f. 3-7 days late", 7))
DELAY_ELSE = "g. 7+ days late"

DELAY_BIN_EDGES = (-999, -10, -5, -3, 0, 3, 5, 10, 999)
DELAY_BIN_LABELS = ("10+ early", "5-10 early", "3-5 early", "0-3 early", "0-3 late",
                    "3-5 late", "5-10 late", "10+ late")

DRIVER_MEASURES = ("delivery_days", "handling_days", "transit_days", "delay_days",
                   "order_revenue", "order_freight", "freight_pct", "item_count")


def share(cond: F.Column, n: F.Column | None = None) -> F.Column:
    return pct(count_when(cond), n if n is not None else F.count(F.lit(1)))


@query("review_distribution")
def review_distribution(t) -> DataFrame:
    """Per review score: orders, share, commented orders, comment rate."""
    g = (t.reviewed.groupBy("review_score")
         .agg(F.count(F.lit(1)).alias("count"),
              count_when(F.col("has_comment")).alias("with_comment"),
              rnd(share(F.col("has_comment")), 1).alias("comment_rate")))
    return g.select("review_score", "count",
                    rnd(pct(F.col("count"), F.sum("count").over(_all())), 1).alias("pct"),
                    "with_comment", "comment_rate").orderBy("review_score")


@query("review_by_delivery_outcome")
def review_by_delivery_outcome(t) -> DataFrame:
    """Late vs on-time scored deliveries: mean score, 5-star, 1-star, low shares."""
    s = t.reviewed.where(F.col("delivery_days").isNotNull())
    score = F.col("review_score")
    return s.groupBy(F.when(F.col("is_late"), "Late").otherwise("On Time / Early")
                     .alias("delivery_status")).agg(
        F.count(F.lit(1)).alias("orders"), rnd(avg_exact("review_score"), 2).alias("avg_score"),
        rnd(share(score == 5), 1).alias("pct_5star"), rnd(share(score == 1), 1).alias("pct_1star"),
        rnd(share(score <= 2), 1).alias("pct_low"))


@query("delay_bands_reviews")
def delay_bands_reviews(t) -> DataFrame:
    """Scored deliveries by delay band (7/3/0 days): mean score, 5-star and 1-star shares."""
    score = F.col("review_score")
    return (t.reviewed_delivered
            .groupBy(band_chain("delay_days", DELAY_BANDS, DELAY_ELSE).alias("delay_bucket"))
            .agg(F.count(F.lit(1)).alias("orders"), rnd(avg_exact("review_score"), 2).alias("avg_score"),
                 rnd(share(score == 5), 1).alias("pct_5star"),
                 rnd(share(score == 1), 1).alias("pct_1star"))
            .orderBy("delay_bucket"))


def _late_of_delivered() -> F.Column:
    return rnd(pct(count_when(F.col("is_late")), count_when(F.col("delivery_days").isNotNull())), 1)


@query("lowest_rated_categories")
def lowest_rated_categories(t) -> DataFrame:
    """Categories with 50+ scored orders, lowest mean score first."""
    g = (t.item_view.where(F.col("review_score").isNotNull()).groupBy("product_category_english")
         .agg(F.count_distinct("order_id").alias("orders"),
              avg_exact("review_score").alias("_s"),
              rnd(share(F.col("review_score") <= 2), 1).alias("pct_low"),
              _late_of_delivered().alias("late_pct"),
              rnd(F.avg("delivery_days"), 1).alias("avg_delivery"))
         .where(F.col("orders") >= t.cfg.min_orders_group))
    return (g.select("product_category_english", "orders", rnd("_s", 2).alias("avg_score"), "pct_low",
                     "late_pct", "avg_delivery")
            .orderBy("avg_score", "product_category_english").limit(t.cfg.bottom_categories))


@query("review_by_state")
def review_by_state(t) -> DataFrame:
    """States with 50+ scored orders: score, low share, delivery days, late share."""
    g = (t.reviewed.groupBy("customer_state")
         .agg(F.count(F.lit(1)).alias("orders"), avg_exact("review_score").alias("_s"),
              rnd(share(F.col("review_score") <= 2), 1).alias("pct_low"),
              rnd(F.avg("delivery_days"), 1).alias("avg_delivery"),
              _late_of_delivered().alias("late_pct"))
         .where(F.col("orders") >= t.cfg.min_orders_group))
    return g.select("customer_state", "orders", rnd("_s", 2).alias("avg_score"), "pct_low",
                    "avg_delivery", "late_pct").orderBy("avg_score", "customer_state")


@query("multi_factor_satisfaction")
def multi_factor_satisfaction(t) -> DataFrame:
    """Late x freight tier x single/multi item: orders (30+), score, 1-star share."""
    cfg = t.cfg
    s = t.reviewed.where(F.col("delivery_days").isNotNull())
    # NULL freight_pct is not > 30, so it is 'Normal Freight' (as the SQL).
    high = F.coalesce(F.col("freight_pct") > cfg.high_freight_pct, F.lit(False))
    g = (s.groupBy(F.when(F.col("is_late"), "Late").otherwise("On Time").alias("delivery"),
                   F.when(high, "High Freight").otherwise("Normal Freight").alias("freight_tier"),
                   F.when(F.col("item_count") > 1, "Multi-Item").otherwise("Single Item")
                   .alias("order_type"))
         .agg(F.count(F.lit(1)).alias("orders"), avg_exact("review_score").alias("_s"),
              rnd(share(F.col("review_score") == 1), 1).alias("pct_1star"))
         .where(F.col("orders") >= cfg.min_orders_multi_factor))
    return g.select("delivery", "freight_tier", "order_type", "orders",
                    rnd("_s", 2).alias("avg_score"), "pct_1star").orderBy("avg_score")


@query("seller_state_dissatisfaction")
def seller_state_dissatisfaction(t) -> DataFrame:
    """Seller states with 50+ scored orders, lowest mean review first."""
    g = (t.item_view.where(F.col("review_score").isNotNull()).groupBy("seller_state")
         .agg(F.count_distinct("order_id").alias("orders"), avg_exact("review_score").alias("_r"),
              rnd(F.avg("delivery_days"), 1).alias("avg_delivery"),
              rnd(F.avg("handling_days"), 1).alias("avg_handling"),
              _late_of_delivered().alias("late_pct"))
         .where(F.col("orders") >= t.cfg.min_orders_group))
    return (g.select("seller_state", "orders", rnd("_r", 2).alias("avg_review"), "avg_delivery",
                     "avg_handling", "late_pct")
            .orderBy("avg_review", "seller_state").limit(t.cfg.bottom_categories))


# ---------------------------------------------------------------- notebook --

@query("score_distribution")
def score_distribution(t) -> DataFrame:
    """Orders and share per review score (unrounded)."""
    g = t.reviewed.groupBy("review_score").agg(F.count(F.lit(1)).alias("orders"))
    return g.select("review_score", "orders",
                    pct(F.col("orders"), F.sum("orders").over(_all())).alias("pct")).orderBy("review_score")


@query("delay_spearman")
def delay_spearman(t) -> DataFrame:
    """Rank correlation of delay days with review score."""
    return stats.spearman(t.reviewed_delivered, "order_id", [("delay_days", "review_score")])


@query("delay_spearman_test")
def delay_spearman_test(t) -> DataFrame:
    """delay_spearman with its two-sided p-value and significance stars."""
    return stats.spearman_test(stats.spearman_raw(t.reviewed_delivered, "order_id", [("delay_days", "review_score")]))


@query("delay_buckets8")
def delay_buckets8(t) -> DataFrame:
    """The published delay_vs_reviews table: right-closed bins."""
    b = right_closed_bins("delay_days", DELAY_BIN_EDGES, DELAY_BIN_LABELS)
    score = F.col("review_score")
    g = (t.reviewed_delivered.where(b.isNotNull()).groupBy(b.alias("delay_bucket"))
         .agg(F.count(F.lit(1)).alias("orders"), avg_exact("review_score").alias("avg_score"),
              share(score == 1).alias("pct_1star"), share(score == 5).alias("pct_5star")))
    return g.orderBy(ordinal_of(F.col("delay_bucket"), DELAY_BIN_LABELS))


STAR_METRICS = (("Delivery Days", "delivery_days"), ("Handling Days", "handling_days"),
                ("Transit Days", "transit_days"), ("Delay Days", "delay_days"),
                ("Order Revenue", "order_revenue"), ("Item Count", "item_count"),
                ("Freight %", "freight_pct"))


@query("star_profile")
def star_profile(t) -> DataFrame:
    """1-star vs 5-star orders: seven means, late rate and comment rate."""
    s = t.reviewed_delivered.where(F.col("review_score").isin(1, 5))
    aggs = []
    for i, (_, c) in enumerate(STAR_METRICS):
        for k in (1, 5):
            x = F.when(F.col("review_score") == k, F.col(c))
            aggs.append((F.sum(x).cast("double") / F.count(x)).alias(f"m{i}_{k}"))
    for i, c in ((7, "is_late"), (8, "has_comment")):
        for k in (1, 5):
            on = F.col("review_score") == k
            aggs.append(pct(count_when(on & F.col(c)), count_when(on)).alias(f"m{i}_{k}"))
    wide = s.agg(*aggs)
    names = [n for n, _ in STAR_METRICS] + ["Late Delivery Rate %", "Has Comment Rate %"]
    rows = ", ".join(f"'{n}', m{i}_1, m{i}_5" for i, n in enumerate(names))
    long = wide.selectExpr(f"stack({len(names)}, {rows}) as (metric, one_star, five_star)")
    return long.select("metric", rnd("one_star", 4).alias("one_star"),
                       rnd("five_star", 4).alias("five_star"),
                       rnd(F.col("one_star") - F.col("five_star"), 4).alias("difference"))


DRIVER_PAIRS = tuple((c, "review_score") for c in DRIVER_MEASURES)
DRIVER_COLUMNS = ("order_id", "review_score", *DRIVER_MEASURES)


@query("spearman_drivers")
def spearman_drivers(t) -> DataFrame:
    """Rank correlation of eight order measures with review score (listwise complete rows)."""
    return stats.spearman(t.measured(*DRIVER_COLUMNS).reviewed_delivered, "order_id", DRIVER_PAIRS)


@query("spearman_drivers_test")
def spearman_drivers_test(t) -> DataFrame:
    """spearman_drivers with p-values and significance stars."""
    return stats.spearman_test(stats.spearman_raw(t.measured(*DRIVER_COLUMNS).reviewed_delivered, "order_id", DRIVER_PAIRS))


@query("spearman_matrix")
def spearman_matrix(t) -> DataFrame:
    """9 x 9 rank correlations (long form: x, y, rho), average ranks for ties,
    over the rows without a NULL in any of the nine columns."""
    cols = ["review_score", *DRIVER_MEASURES]
    raw = stats.spearman_raw(t.measured(*DRIVER_COLUMNS).reviewed_delivered, "order_id",
                             [(x, y) for x in cols for y in cols])
    return raw.select("x", "y", rnd("rho", 6).alias("rho"))


@query("late_freight_crosstab")
def late_freight_crosstab(t) -> DataFrame:
    """Late x freight tier (no minimum size): orders, score, 1-star share."""
    s = t.reviewed_delivered
    high = F.coalesce(F.col("freight_pct") > t.cfg.high_freight_pct, F.lit(False))
    return (s.groupBy(F.when(F.col("is_late"), "Late").otherwise("On Time").alias("late_label"),
                      F.when(high, "High Freight").otherwise("Normal Freight").alias("freight_label"))
            .agg(F.count(F.lit(1)).alias("orders"), avg_exact("review_score").alias("avg_score"),
                 share(F.col("review_score") == 1).alias("pct_1star"))
            .orderBy("late_label", "freight_label"))
