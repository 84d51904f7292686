"""Distance, freight corridors and seller analyses the README reports
(SURVEY §2.6). Definitions the README does not give are ours and marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats
from ..functions.exprs import avg_exact, count_when, ordinal_of, pct, rnd


def _all():  # only over grouped frames
    return Window.partitionBy()


DIST_LABELS = ("<100 km", "100-500 km", "500-1000 km", "1000-2000 km", "2000+ km")
WEIGHT_LABELS = ("<500 g", "500 g-2 kg", "2-5 kg", ">5 kg")


def haversine_km(lat1, lng1, lat2, lng2, radius_km: float) -> F.Column:
    """Great-circle distance; built-in trig, no UDF."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    a = F.sin(dlat / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dlng / 2) ** 2
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(a))


def zip_centroids(t) -> DataFrame:
    """One row per zip prefix. Nothing bounds the prefixes, so no hint: adaptive
    execution broadcasts them where their measured size allows it."""
    return t.geolocation_clean.select("geolocation_zip_code_prefix", "avg_lat", "avg_lng")


def with_distances(v: DataFrame, g: DataFrame, radius_km: float) -> DataFrame:
    """``v`` with the distance between its seller's and its customer's zip centroid (NULL when either zip has no coordinates)."""
    c = g.select(F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix"),
                 F.col("avg_lat").alias("c_lat"), F.col("avg_lng").alias("c_lng"))
    s = g.select(F.col("geolocation_zip_code_prefix").alias("seller_zip_code_prefix"),
                 F.col("avg_lat").alias("s_lat"), F.col("avg_lng").alias("s_lng"))
    v = v.join(c, "customer_zip_code_prefix", "left").join(s, "seller_zip_code_prefix", "left")
    return v.withColumn("distance_km", haversine_km(F.col("s_lat"), F.col("s_lng"), F.col("c_lat"), F.col("c_lng"), radius_km))


def item_distances(t) -> DataFrame:
    """Items of the view with seller -> customer distance between zip centroids."""
    return with_distances(t.item_view, zip_centroids(t), t.cfg.earth_radius_km)


def distance_band(t, c: str = "distance_km") -> F.Column:
    e1, e2, e3, e4 = t.cfg.distance_edges_km
    d = F.col(c)
    return (F.when(d < e1, DIST_LABELS[0]).when(d < e2, DIST_LABELS[1]).when(d < e3, DIST_LABELS[2])
            .when(d < e4, DIST_LABELS[3]).when(d.isNotNull(), DIST_LABELS[4]))


@query("seller_customer_distance")
def seller_customer_distance(t) -> DataFrame:
    """Every view item with its seller -> customer centroid distance (km)."""
    return item_distances(t).select("order_id", "order_item_id", "seller_id", "customer_state",
                                    "seller_state", rnd("distance_km", 3).alias("distance_km"),
                                    F.col("freight_value").cast("double").alias("freight_value"))


@query("freight_by_distance")
def freight_by_distance(t) -> DataFrame:
    """Items, mean freight and share per distance band (<100 ... 2000+ km)."""
    d = item_distances(t).where(F.col("distance_km").isNotNull())
    g = (d.groupBy(distance_band(t).alias("distance_band"))
         .agg(F.count(F.lit(1)).alias("items"), avg_exact("freight_value").alias("_f")))
    return g.select("distance_band", "items", rnd("_f", 2).alias("avg_freight"),
                    rnd(pct(F.col("items"), F.sum("items").over(_all())), 1).alias("pct_items")
                    ).orderBy(ordinal_of(F.col("distance_band"), DIST_LABELS))


@query("freight_per_km")
def freight_per_km(t) -> DataFrame:
    """OLS of freight on distance: slope per km, intercept, r^2."""
    d = (item_distances(t).where(F.col("distance_km").isNotNull())
         .withColumn("freight", F.col("freight_value").cast("double")))
    return stats.ols(d, "distance_km", "freight")


@query("freight_by_weight_band")
def freight_by_weight_band(t) -> DataFrame:
    """Weight bands <500 g, 500 g-2 kg, 2-5 kg, >5 kg (edges ours): items,
    share, and the mean of each item's freight/price ratio."""
    e1, e2, e3 = t.cfg.weight_band_edges_g
    w = F.col("product_weight_g")
    band = (F.when(w < e1, WEIGHT_LABELS[0]).when(w < e2, WEIGHT_LABELS[1])
            .when(w <= e3, WEIGHT_LABELS[2]).otherwise(WEIGHT_LABELS[3]))
    ratio = F.when(F.col("price") > 0, F.col("freight_value").cast("double") * 100.0
                   / F.col("price").cast("double"))
    g = (t.item_view.where(w.isNotNull()).groupBy(band.alias("weight_band"))
         .agg(F.count(F.lit(1)).alias("items"), F.avg(ratio).alias("_r"),
              avg_exact("freight_value").alias("_f")))
    return g.select("weight_band", "items",
                    rnd(pct(F.col("items"), F.sum("items").over(_all())), 1).alias("pct_items"),
                    rnd("_f", 2).alias("avg_freight"), rnd("_r", 2).alias("avg_freight_ratio_pct")
                    ).orderBy(ordinal_of(F.col("weight_band"), WEIGHT_LABELS))


@query("route_freight")
def route_freight(t) -> DataFrame:
    """Same-state vs cross-state items: mean freight and share of items."""
    from .delivery import route_type
    g = (t.item_view.groupBy(route_type().alias("route_type"))
         .agg(F.count(F.lit(1)).alias("items"), avg_exact("freight_value").alias("_f")))
    return g.select("route_type", "items", rnd("_f", 2).alias("avg_freight"),
                    rnd(pct(F.col("items"), F.sum("items").over(_all())), 1).alias("pct_items"))


def seller_profile(t) -> DataFrame:
    return (t.item_view.groupBy("seller_id")
            .agg(F.count_distinct("order_id").alias("orders"),
                 F.max("seller_state").alias("seller_state"),
                 F.avg("processing_days").alias("avg_processing_days")))


@query("seller_volume_tiers")
def seller_volume_tiers(t) -> DataFrame:
    """Sellers by distinct orders: <10, 10-99, 100+ (middle edge ours)."""
    lo, hi = t.cfg.seller_tier_edges
    labels = (f"<{lo} orders", f"{lo}-{hi - 1} orders", f"{hi}+ orders")
    n = F.col("orders")
    tier = F.when(n < lo, labels[0]).when(n < hi, labels[1]).otherwise(labels[2])
    g = (seller_profile(t).groupBy(tier.alias("seller_tier"))
         .agg(F.count(F.lit(1)).alias("sellers"), F.sum("orders").alias("orders"),
              F.avg("avg_processing_days").alias("_p")))
    return g.select("seller_tier", "sellers",
                    rnd(pct(F.col("sellers"), F.sum("sellers").over(_all())), 1).alias("pct_sellers"),
                    "orders", rnd("_p", 2).alias("avg_processing_days")
                    ).orderBy(ordinal_of(F.col("seller_tier"), labels))


@query("slowest_sellers")
def slowest_sellers(t) -> DataFrame:
    """Sellers at or above the 90th percentile of mean processing time
    (the slowest 10 %). The threshold comes from the distributed quantile
    operator, over one row per seller."""
    # One row per seller; the threshold passes over it twice, the picks once more.
    p = t.kept(seller_profile(t).where(F.col("avg_processing_days").isNotNull()))
    cut = stats.quantiles(p, "avg_processing_days", [1.0 - t.cfg.slowest_seller_share], ["cut"],
                          t.cfg.exact_percentiles, t.cfg.approx_accuracy)
    return (p.crossJoin(F.broadcast(cut)).where(F.col("avg_processing_days") >= F.col("cut"))
            .select("seller_id", "seller_state", "orders",
                    rnd("avg_processing_days", 4).alias("avg_processing_days"))
            .orderBy(F.desc("avg_processing_days"), "seller_id"))


@query("state_supply_demand")
def state_supply_demand(t) -> DataFrame:
    """Share of sellers vs share of (distinct) customers by state."""
    s = t["sellers"].groupBy(F.col("seller_state").alias("state")).agg(
        F.count(F.lit(1)).alias("sellers"))
    c = t["customers"].groupBy(F.col("customer_state").alias("state")).agg(
        F.count_distinct("customer_unique_id").alias("customers"))
    j = s.join(c, "state", "full").na.fill(0, ["sellers", "customers"])
    sp = pct(F.col("sellers"), F.sum("sellers").over(_all()))
    cp = pct(F.col("customers"), F.sum("customers").over(_all()))
    return j.select("state", "sellers", rnd(sp, 2).alias("seller_pct"), "customers",
                    rnd(cp, 2).alias("customer_pct"), rnd(cp - sp, 2).alias("demand_minus_supply_pct")
                    ).orderBy(F.desc("customers"), "state")


@query("top_state_share")
def top_state_share(t) -> DataFrame:
    """Cumulative order share of the top customer states."""
    g = t.orders_summary.groupBy("customer_state").agg(F.count(F.lit(1)).alias("orders"))
    w = Window.orderBy(F.desc("orders"), "customer_state")
    r = g.select("customer_state", "orders", F.row_number().over(w).cast("long").alias("rank"),
                 F.sum("orders").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                 F.sum("orders").over(_all()).alias("_tot"))
    return (r.where(F.col("rank") <= t.cfg.top_state_share_n)
            .select("rank", "customer_state", "orders",
                    rnd(pct(F.col("_cum"), F.col("_tot")), 2).alias("cumulative_pct"))
            .orderBy("rank"))


@query("buffer_whatif")
def buffer_whatif(t) -> DataFrame:
    """Late orders that would be on time if the estimate were n days longer
    on routes over the distance cut (order distance = its longest item)."""
    cfg = t.cfg
    # An order's distances are those to its different sellers: no products, payments or line numbers are needed. The
    # centroids, a row each, are looked up for both ends, so they are worked out once.
    lines = t.raw.get("order_lines", t["order_items"]).select("order_id", "seller_id").distinct()
    orders = t.orders_enriched.where(F.col("delivery_days").isNotNull()).select(
        "order_id", "delivery_days", "delay_days", "is_late", "customer_zip_code_prefix")
    ends = lines.join(orders, "order_id").join(t["sellers"].select("seller_id", "seller_zip_code_prefix"), "seller_id", "left")
    d = (with_distances(ends, t.kept(zip_centroids(t)), cfg.earth_radius_km).groupBy("order_id")
         .agg(F.max("distance_km").alias("order_km"), F.max("delay_days").alias("delay_days"),
              F.bool_or("is_late").alias("is_late")))
    long = F.coalesce(F.col("order_km") > cfg.whatif_min_km, F.lit(False))
    late_after = F.when(long, F.col("delay_days") > float(cfg.whatif_extra_days)).otherwise(F.col("is_late"))
    n = F.count(F.lit(1))
    g = d.agg(n.alias("delivered_orders"), count_when(long).alias("long_route_orders"),
              count_when(F.col("is_late")).alias("late_before"), count_when(late_after).alias("late_after"))
    return g.select("delivered_orders", "long_route_orders", "late_before", "late_after",
                    (F.col("late_before") - F.col("late_after")).alias("rescued_orders"),
                    rnd(pct(F.col("late_before"), F.col("delivered_orders")), 2).alias("late_pct_before"),
                    rnd(pct(F.col("late_after"), F.col("delivered_orders")), 2).alias("late_pct_after"))
