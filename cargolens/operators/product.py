"""Product performance (reference category 2, and the notebook's twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.exprs import avg_exact, ordinal_of, pct, right_closed_bins, rnd


def _all():  # only ever over grouped, per-category frames
    return Window.partitionBy()


# Fixed values (must equal the reference's): description-length bins and labels.
DESC_EDGES = (0, 200, 500, 1000, 10000)
DESC_LABELS = ("Short (<200)", "Medium (200-500)", "Long (500-1K)", "Very Long (1K+)")


def _cat_agg(v: DataFrame) -> DataFrame:
    return v.groupBy("product_category_english").agg(
        F.count_distinct("order_id").alias("orders"),
        F.count(F.lit(1)).alias("items"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"),
        avg_exact("price").alias("avg_price"),
        avg_exact("freight_value").alias("avg_freight"),
        avg_exact("review_score").alias("avg_review"),
        avg_exact("product_weight_g").alias("avg_weight"),
    )


@query("top_categories")
def top_categories(t) -> DataFrame:
    """Top categories by revenue. items_sold counts items (the SQL summed
    the per-order sequence numbers; SURVEY §1.6a)."""
    g = _cat_agg(t.item_view)
    return (g.orderBy(F.desc("revenue"), "product_category_english")
            .limit(t.cfg.top_categories)
            .select("product_category_english", "orders", F.col("items").alias("items_sold"),
                    rnd("revenue", 2).alias("total_revenue"), rnd("avg_price", 2).alias("avg_price"),
                    rnd("freight", 2).alias("total_freight"),
                    rnd(pct(F.col("freight"), F.col("revenue")), 1).alias("freight_pct"),
                    rnd("avg_review", 2).alias("avg_review")))


def ranked_categories(t) -> DataFrame:
    cat = t.item_view.groupBy("product_category_english").agg(F.sum("price").alias("revenue"))
    by_rev = Window.orderBy(F.desc("revenue"))
    return cat.select(
        "product_category_english", "revenue",
        F.sum("revenue").over(by_rev).alias("cumulative"),          # RANGE frame: ties share
        F.sum("revenue").over(_all()).alias("grand_total"),
        F.row_number().over(Window.orderBy(F.desc("revenue"), "product_category_english"))
        .cast("long").alias("rank"),
        F.count(F.lit(1)).over(_all()).alias("total_categories"))


@query("category_pareto")
def category_pareto(t) -> DataFrame:
    """Category revenue rank, cumulative share and Top 80% / Long Tail label."""
    r = ranked_categories(t)
    share = pct(F.col("cumulative"), F.col("grand_total"))
    return r.select(
        "rank", "product_category_english", F.col("revenue").cast("double").alias("revenue"),
        rnd(share, 1).alias("cumul_pct"),
        F.when(share <= t.cfg.pareto_cut_pct, "Top 80%").otherwise("Long Tail").alias("pareto_group"),
    ).orderBy("rank")


@query("freight_ratio_by_category")
def freight_ratio_by_category(t) -> DataFrame:
    """Categories with 100+ items by freight as a share of price."""
    g = (t.item_view.where(F.col("product_category_english") != "unknown")
         .groupBy("product_category_english")
         .agg(F.count(F.lit(1)).alias("items_sold"),
              avg_exact("price").alias("ap"), avg_exact("freight_value").alias("af"),
              avg_exact("product_weight_g").alias("aw"), avg_exact("review_score").alias("ar"))
         .where(F.col("items_sold") >= t.cfg.min_items_freight_ratio))
    out = g.select("product_category_english", "items_sold", rnd("ap", 2).alias("avg_price"),
                   rnd("af", 2).alias("avg_freight"),
                   rnd(pct(F.col("af"), F.col("ap")), 1).alias("freight_pct"),
                   rnd("aw", 0).alias("avg_weight_g"), rnd("ar", 2).alias("avg_review"))
    return out.orderBy(F.desc("freight_pct"), "product_category_english").limit(t.cfg.top_categories)


def items_in_window(t) -> DataFrame:
    """orders_clean (window) x order_items, product and review left-joined,
    without the customer join (as the reference's size and photo queries)."""
    o = t.orders_window.select("order_id")
    r = t.reviews_clean.select("order_id", "review_score")
    p = t.products_clean.select("product_id", "product_size_tier", "product_photos_qty")
    return (t["order_items"].select("order_id", "product_id", "price", "freight_value")
            .join(o, "order_id").join(r, "order_id", "left").join(p, "product_id", "left"))


@query("size_tier_freight")
def size_tier_freight(t) -> DataFrame:
    """Per size tier (known weight): items, price, freight, freight share, review."""
    g = (items_in_window(t).where(F.col("product_size_tier") != "unknown")
         .groupBy("product_size_tier")
         .agg(F.count(F.lit(1)).alias("items_sold"), avg_exact("price").alias("ap"),
              avg_exact("freight_value").alias("af"), avg_exact("review_score").alias("ar")))
    return g.select("product_size_tier", "items_sold", rnd("ap", 2).alias("avg_price"),
                    rnd("af", 2).alias("avg_freight"),
                    rnd(pct(F.col("af"), F.col("ap")), 1).alias("freight_pct"),
                    rnd("ar", 2).alias("avg_review"), "af").orderBy(F.desc("af")).drop("af")


@query("top5_category_trend")
def top5_category_trend(t) -> DataFrame:
    """Monthly revenue and orders of the five top-revenue categories."""
    v = t.item_view
    top = (v.groupBy("product_category_english").agg(F.sum("price").alias("rev"))
           .orderBy(F.desc("rev"), "product_category_english").limit(t.cfg.top_trend_categories)
           .select("product_category_english"))
    # top holds top_trend_categories rows: a broadcast of fixed size.
    return (v.join(F.broadcast(top), "product_category_english", "left_semi")
            .groupBy("order_month", "product_category_english")
            .agg(rnd(F.sum("price"), 2).alias("monthly_revenue"),
                 F.count_distinct("order_id").alias("orders"))
            .orderBy("order_month", "product_category_english"))


def photo_bucket(c: str) -> F.Column:
    """NULL 'unknown'; 0 gets its own bucket (the SQL put it in '2-3 photos',
    SURVEY §1.6h)."""
    x = F.col(c)
    return (F.when(x.isNull(), "unknown").when(x == 0, "0 photos").when(x == 1, "1 photo")
            .when(x <= 3, "2-3 photos").otherwise("4+ photos"))


@query("photo_bucket_reviews")
def photo_bucket_reviews(t) -> DataFrame:
    """Items, review and price by number of product photos."""
    g = (items_in_window(t).groupBy(photo_bucket("product_photos_qty").alias("photo_bucket"))
         .agg(F.count(F.lit(1)).alias("items"), avg_exact("review_score").alias("ar"),
              avg_exact("price").alias("ap")))
    return g.select("photo_bucket", "items", rnd("ar", 2).alias("avg_review"),
                    rnd("ap", 2).alias("avg_price")).orderBy(F.desc("avg_review"), "photo_bucket")


# ---------------------------------------------------------------- notebook --

@query("category_performance")
def category_performance(t) -> DataFrame:
    """The published category_performance table: every category, unrounded."""
    g = _cat_agg(t.item_view)
    return g.select(F.col("product_category_english").alias("product_category_name_english"),
                    F.col("revenue").cast("double").alias("revenue"), "orders", "items",
                    "avg_price", "avg_freight", "avg_review").orderBy(F.desc("revenue"))


@query("pareto_point")
def pareto_point(t) -> DataFrame:
    """Categories needed to reach the cut; the crossing category counts.

    Cumulated by rank (a ROWS frame, as pandas cumsum), unlike the SQL label.
    """
    cat = t.item_view.groupBy("product_category_english").agg(F.sum("price").alias("revenue"))
    w = Window.orderBy(F.desc("revenue"), "product_category_english")
    r = cat.select("revenue",
                   F.row_number().over(w).cast("long").alias("rank"),
                   F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                   F.sum("revenue").over(_all()).alias("total"),
                   F.count(F.lit(1)).over(_all()).alias("n"))
    hit = pct(F.col("cum"), F.col("total")) >= t.cfg.pareto_cut_pct
    g = r.agg(F.min(F.when(hit, F.col("rank"))).alias("pareto_n"),
              F.max("n").alias("total_categories"))
    return g.select("pareto_n", "total_categories",
                    rnd(pct(F.col("pareto_n"), F.col("total_categories")), 1).alias("pareto_share_pct"))


@query("freight_risk_bands")
def freight_risk_bands(t) -> DataFrame:
    """Top categories by freight ratio, banded >50 % / >30 % / normal."""
    cfg = t.cfg
    g = (_cat_agg(t.item_view.where(F.col("product_category_english") != "unknown"))
         .where(F.col("items") >= cfg.min_items_freight_ratio))
    fp = pct(F.col("avg_freight"), F.col("avg_price"))
    band = (F.when(fp > cfg.freight_risk_high_pct, "high (>50%)")
            .when(fp > cfg.high_freight_pct, "elevated (>30%)").otherwise("normal"))
    return (g.select("product_category_english", "items", rnd(fp, 1).alias("freight_pct"),
                     band.alias("risk_band"), fp.alias("_fp"))
            .orderBy(F.desc("_fp"), "product_category_english").limit(cfg.top_freight_risk)
            .drop("_fp"))


@query("description_length_buckets")
def description_length_buckets(t) -> DataFrame:
    """Items and mean review by description length bin (right-closed)."""
    b = right_closed_bins("product_description_length", DESC_EDGES, DESC_LABELS)
    g = (t.item_view.where(b.isNotNull()).groupBy(b.alias("desc_bucket"))
         .agg(F.count(F.lit(1)).alias("items"), avg_exact("review_score").alias("avg_review")))
    return g.orderBy(ordinal_of(F.col("desc_bucket"), DESC_LABELS))


@query("category_score_matrix")
def category_score_matrix(t) -> DataFrame:
    """Top categories by distinct orders x review score (row %), sorted by
    mean score. pivot() is given the five scores, so no extra pass."""
    v = t.item_view
    top = (v.groupBy("product_category_english").agg(F.count_distinct("order_id").alias("n"))
           .orderBy(F.desc("n"), "product_category_english").limit(t.cfg.top_categories)
           .select("product_category_english"))
    s = (v.where(F.col("review_score").isNotNull())
         .join(F.broadcast(top), "product_category_english", "left_semi"))
    piv = (s.groupBy("product_category_english").pivot("review_score", [1, 2, 3, 4, 5])
           .agg(F.count(F.lit(1))).na.fill(0))
    # One pass: the row total and the mean score follow exactly from the five
    # counts (scores are the integers 1..5), so no second aggregate or join.
    n = sum(F.col(str(k)) for k in range(1, 6))
    mean = sum(F.col(str(k)) * k for k in range(1, 6)).cast("double") / n.cast("double")
    return piv.select("product_category_english",
                      *[pct(F.col(str(k)), n).alias(f"pct_{k}star") for k in range(1, 6)],
                      mean.alias("avg_score")).orderBy("avg_score", "product_category_english")
