"""Oracle SQL (DuckDB) for the distance, corridor and seller queries."""

from __future__ import annotations

from ..catalog import oracle
from .oracle_base import AVGX, CNT, PCT, R


def _dist_items(cfg) -> str:
    r2 = 2.0 * cfg.earth_radius_km
    return f"""
    dist_items AS (
        SELECT v.*,
               {r2}::DOUBLE * asin(sqrt(pow(sin(radians(c.avg_lat - s.avg_lat) / 2), 2)
                   + cos(radians(s.avg_lat)) * cos(radians(c.avg_lat))
                     * pow(sin(radians(c.avg_lng - s.avg_lng) / 2), 2))) AS distance_km
        FROM vw_orders_analysis v
        LEFT JOIN geolocation_clean c ON v.customer_zip_code_prefix = c.geolocation_zip_code_prefix
        LEFT JOIN geolocation_clean s ON v.seller_zip_code_prefix = s.geolocation_zip_code_prefix)"""


def _band(cfg) -> str:
    e1, e2, e3, e4 = cfg.distance_edges_km
    return (f"CASE WHEN distance_km < {e1} THEN '<100 km' WHEN distance_km < {e2} THEN '100-500 km' "
            f"WHEN distance_km < {e3} THEN '500-1000 km' WHEN distance_km < {e4} THEN '1000-2000 km' "
            f"WHEN distance_km IS NOT NULL THEN '2000+ km' END")


@oracle("seller_customer_distance")
def seller_customer_distance(cfg):
    return f"""WITH {_dist_items(cfg)}
    SELECT order_id, order_item_id, seller_id, customer_state, seller_state,
           {R('distance_km', 3)} AS distance_km, CAST(freight_value AS DOUBLE) AS freight_value
    FROM dist_items"""


@oracle("freight_by_distance")
def freight_by_distance(cfg):
    return f"""WITH {_dist_items(cfg)}
    SELECT {_band(cfg)} AS distance_band, COUNT(*) AS items,
           {R(AVGX('freight_value'), 2)} AS avg_freight,
           {R(PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct_items
    FROM dist_items WHERE distance_km IS NOT NULL GROUP BY 1"""


@oracle("freight_per_km")
def freight_per_km(cfg):
    return f"""WITH {_dist_items(cfg)},
    g AS (SELECT COUNT(freight_value) AS n, regr_slope(CAST(freight_value AS DOUBLE), distance_km) AS slope,
                 regr_intercept(CAST(freight_value AS DOUBLE), distance_km) AS intercept,
                 regr_r2(CAST(freight_value AS DOUBLE), distance_km) AS r2
          FROM dist_items WHERE distance_km IS NOT NULL)
    SELECT n, {R('slope', 6)} AS slope, {R('intercept', 6)} AS intercept, {R('r2', 6)} AS r_squared,
           {R('sign(slope) * sqrt(r2) * sqrt((n - 2.0) / (1.0 - r2))', 6)} AS t_stat
    FROM g"""


@oracle("freight_by_weight_band")
def freight_by_weight_band(cfg):
    e1, e2, e3 = cfg.weight_band_edges_g
    return f"""
    SELECT CASE WHEN product_weight_g < {e1} THEN '<500 g' WHEN product_weight_g < {e2} THEN '500 g-2 kg'
                WHEN product_weight_g <= {e3} THEN '2-5 kg' ELSE '>5 kg' END AS weight_band,
           COUNT(*) AS items, {R(PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct_items,
           {R(AVGX('freight_value'), 2)} AS avg_freight,
           {R('AVG(CASE WHEN price > 0 THEN CAST(freight_value AS DOUBLE) * 100.0::DOUBLE / CAST(price AS DOUBLE) END)', 2)}
                AS avg_freight_ratio_pct
    FROM vw_orders_analysis WHERE product_weight_g IS NOT NULL GROUP BY 1"""


@oracle("route_freight")
def route_freight(cfg):
    return f"""
    SELECT CASE WHEN customer_state = seller_state THEN 'Same State' ELSE 'Cross State' END AS route_type,
           COUNT(*) AS items, {R(AVGX('freight_value'), 2)} AS avg_freight,
           {R(PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct_items
    FROM vw_orders_analysis GROUP BY 1"""


_SELLERS = """
    sellers_p AS (SELECT seller_id, COUNT(DISTINCT order_id) AS orders, MAX(seller_state) AS seller_state,
                         AVG(processing_days) AS avg_processing_days
                  FROM vw_orders_analysis GROUP BY seller_id)"""


@oracle("seller_volume_tiers")
def seller_volume_tiers(cfg):
    lo, hi = cfg.seller_tier_edges
    return f"""WITH {_SELLERS}
    SELECT CASE WHEN orders < {lo} THEN '<{lo} orders' WHEN orders < {hi} THEN '{lo}-{hi - 1} orders'
                ELSE '{hi}+ orders' END AS seller_tier,
           COUNT(*) AS sellers, {R(PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct_sellers,
           CAST(SUM(orders) AS BIGINT) AS orders, {R('AVG(avg_processing_days)', 2)} AS avg_processing_days
    FROM sellers_p GROUP BY 1"""


@oracle("slowest_sellers")
def slowest_sellers(cfg):
    return f"""WITH {_SELLERS},
    p AS (SELECT * FROM sellers_p WHERE avg_processing_days IS NOT NULL),
    c AS (SELECT PERCENTILE_CONT({1.0 - cfg.slowest_seller_share}) WITHIN GROUP
                 (ORDER BY avg_processing_days) AS cut FROM p)
    SELECT seller_id, seller_state, orders, {R('avg_processing_days', 4)} AS avg_processing_days
    FROM p, c WHERE avg_processing_days >= cut"""


@oracle("state_supply_demand")
def state_supply_demand(cfg):
    sp = PCT("sellers", "SUM(sellers) OVER ()")
    cp = PCT("customers", "SUM(customers) OVER ()")
    return f"""
    WITH s AS (SELECT seller_state AS state, COUNT(*) AS sellers FROM r_sellers GROUP BY 1),
    c AS (SELECT customer_state AS state, COUNT(DISTINCT customer_unique_id) AS customers
          FROM r_customers GROUP BY 1),
    j AS (SELECT COALESCE(s.state, c.state) AS state, COALESCE(sellers, 0) AS sellers,
                 COALESCE(customers, 0) AS customers
          FROM s FULL OUTER JOIN c ON s.state = c.state)
    SELECT state, sellers, {R(sp, 2)} AS seller_pct, customers, {R(cp, 2)} AS customer_pct,
           {R(f'{cp} - {sp}', 2)} AS demand_minus_supply_pct
    FROM j"""


@oracle("top_state_share")
def top_state_share(cfg):
    return f"""
    WITH g AS (SELECT customer_state, COUNT(*) AS orders FROM orders_summary GROUP BY 1),
    r AS (SELECT customer_state, orders,
                 row_number() OVER (ORDER BY orders DESC, customer_state) AS rank,
                 SUM(orders) OVER (ORDER BY orders DESC, customer_state
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                 SUM(orders) OVER () AS tot FROM g)
    SELECT rank, customer_state, orders, {R(PCT('cum', 'tot'), 2)} AS cumulative_pct
    FROM r WHERE rank <= {cfg.top_state_share_n} ORDER BY rank"""


@oracle("buffer_whatif")
def buffer_whatif(cfg):
    late_after = (f"CASE WHEN COALESCE(order_km > {cfg.whatif_min_km}, FALSE) "
                  f"THEN delay_days > {float(cfg.whatif_extra_days)} ELSE is_late END")
    lb = "SUM(CASE WHEN is_late THEN 1 ELSE 0 END)"
    la = f"SUM(CASE WHEN {late_after} THEN 1 ELSE 0 END)"
    return f"""WITH {_dist_items(cfg)},
    od AS (SELECT order_id, MAX(distance_km) AS order_km FROM dist_items GROUP BY order_id),
    d AS (SELECT o.order_id, o.delay_days, o.is_late, od.order_km
          FROM delivered_orders o LEFT JOIN od ON o.order_id = od.order_id)
    SELECT COUNT(*) AS delivered_orders,
           {CNT(f'COALESCE(order_km > {cfg.whatif_min_km}, FALSE)')} AS long_route_orders,
           CAST({lb} AS BIGINT) AS late_before, CAST({la} AS BIGINT) AS late_after,
           CAST({lb} - {la} AS BIGINT) AS rescued_orders,
           {R(PCT(lb, 'COUNT(*)'), 2)} AS late_pct_before, {R(PCT(la, 'COUNT(*)'), 2)} AS late_pct_after
    FROM d"""
