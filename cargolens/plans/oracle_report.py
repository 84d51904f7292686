"""Oracle SQL (DuckDB) for the star schema and the KPI report."""

from __future__ import annotations

from ..catalog import oracle
from .oracle_base import AVGX, PCT, R
from .oracle_geo import _dist_items


@oracle("fact_deliveries")
def fact_deliveries(cfg):
    return """
    SELECT order_id, customer_unique_id, CAST(order_purchase_timestamp AS DATE) AS date_key,
           order_month, customer_state, delivery_days, handling_days, processing_days, transit_days,
           delay_days, estimated_delivery_days, is_late, review_score, item_count,
           CAST(order_revenue AS DOUBLE) AS order_revenue, CAST(order_freight AS DOUBLE) AS order_freight
    FROM delivered_orders"""


@oracle("fact_order_economics")
def fact_order_economics(cfg):
    return f"""WITH {_dist_items(cfg)}
    SELECT order_id, order_item_id, product_id, seller_id, customer_unique_id,
           CAST(order_purchase_timestamp AS DATE) AS date_key, order_month,
           CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
           CAST(total_item_value AS DOUBLE) AS total_item_value,
           CASE WHEN price > 0 THEN CAST(freight_value AS DOUBLE) * 100.0::DOUBLE / CAST(price AS DOUBLE)
                END AS freight_pct,
           {R('distance_km', 3)} AS distance_km
    FROM dist_items"""


@oracle("dim_seller")
def dim_seller(cfg):
    return """
    SELECT s.seller_id, s.seller_city, s.seller_state, s.seller_zip_code_prefix,
           g.avg_lat AS lat, g.avg_lng AS lng
    FROM r_sellers s LEFT JOIN geolocation_clean g
         ON s.seller_zip_code_prefix = g.geolocation_zip_code_prefix"""


@oracle("dim_customer")
def dim_customer(cfg):
    return """
    WITH c AS (SELECT c.*, o.order_id, o.order_purchase_timestamp
               FROM r_customers c JOIN r_orders o ON c.customer_id = o.customer_id),
    latest AS (SELECT DISTINCT ON (customer_unique_id) customer_unique_id, customer_city,
                      customer_state, customer_zip_code_prefix
               FROM c ORDER BY customer_unique_id, order_purchase_timestamp DESC, order_id DESC)
    SELECT l.customer_unique_id, l.customer_city, l.customer_state, l.customer_zip_code_prefix,
           a.orders, a.first_order, a.last_order
    FROM latest l JOIN (SELECT customer_unique_id, COUNT(*) AS orders,
                               MIN(order_purchase_timestamp) AS first_order,
                               MAX(order_purchase_timestamp) AS last_order
                        FROM c GROUP BY customer_unique_id) a
         ON l.customer_unique_id = a.customer_unique_id"""


@oracle("dim_product")
def dim_product(cfg):
    return """SELECT p.*, (SELECT COUNT(*) FROM r_order_items i WHERE i.product_id = p.product_id) AS items_sold
              FROM products_clean p"""


@oracle("dim_date")
def dim_date(cfg):
    return """
    WITH r AS (SELECT CAST(MIN(order_purchase_timestamp) AS DATE) AS lo,
                      CAST(MAX(order_purchase_timestamp) AS DATE) AS hi FROM r_orders),
    d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date_key FROM r)
    SELECT date_key, CAST(year(date_key) AS INTEGER) AS year, CAST(quarter(date_key) AS INTEGER) AS quarter,
           CAST(month(date_key) AS INTEGER) AS month,
           CAST(date_trunc('month', date_key) AS DATE) AS month_start,
           CAST(dayofweek(date_key) AS INTEGER) AS day_of_week, dayname(date_key) AS day_name,
           dayofweek(date_key) IN (0, 6) AS is_weekend
    FROM d"""


@oracle("dim_geography")
def dim_geography(cfg):
    return """
    SELECT g.*, (SELECT COUNT(*) FROM r_sellers s WHERE s.seller_zip_code_prefix = g.geolocation_zip_code_prefix) AS sellers,
           (SELECT COUNT(*) FROM r_customers c WHERE c.customer_zip_code_prefix = g.geolocation_zip_code_prefix)
                AS customers
    FROM geolocation_clean g"""


def _kpi_ctes(cfg) -> str:
    return f"""
    s AS (SELECT SUM(order_revenue) AS total_revenue, COUNT(*) AS total_orders,
                 COUNT(DISTINCT customer_unique_id) AS unique_customers,
                 {AVGX('order_revenue')} AS avg_order_value,
                 PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(order_revenue AS DOUBLE))
                      AS median_order_value
          FROM orders_summary),
    cat AS (SELECT product_category_english, SUM(price) AS rev FROM vw_orders_analysis GROUP BY 1),
    cr AS (SELECT product_category_english, rev,
                  row_number() OVER (ORDER BY rev DESC, product_category_english) AS rank,
                  SUM(rev) OVER (ORDER BY rev DESC, product_category_english
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                  SUM(rev) OVER () AS tot FROM cat),
    p AS (SELECT COUNT(*) AS active_categories,
                 MAX(CASE WHEN rank = 1 THEN product_category_english END) AS top_category,
                 MIN(CASE WHEN {PCT('cum', 'tot')} >= {cfg.pareto_cut_pct} THEN rank END)
                      AS pareto_categories FROM cr),
    d AS (SELECT AVG(delivery_days) AS avg_delivery_days,
                 {PCT('SUM(CASE WHEN is_late THEN 1 ELSE 0 END)', 'COUNT(*)')} AS late_delivery_rate,
                 AVG(handling_days) AS avg_handling_days, AVG(transit_days) AS avg_transit_days,
                 PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY delivery_days) AS median_delivery_days
          FROM delivered_orders),
    r AS (SELECT {AVGX('review_score')} AS avg_review_score,
                 {PCT('SUM(CASE WHEN review_score = 5 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS five_star_rate,
                 {PCT('SUM(CASE WHEN review_score = 1 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS one_star_rate
          FROM reviewed_orders),
    sp AS (SELECT corr(rx, ry) AS delay_review_spearman
           FROM (SELECT rank() OVER (ORDER BY delay_days)
                        + (COUNT(*) OVER (PARTITION BY delay_days) - 1) / 2.0 AS rx,
                        rank() OVER (ORDER BY review_score)
                        + (COUNT(*) OVER (PARTITION BY review_score) - 1) / 2.0 AS ry
                 FROM rev_del) x),
    k AS (SELECT * FROM s, p, d, r, sp)"""


@oracle("executive_kpis")
def executive_kpis(cfg):
    return f"""WITH {_kpi_ctes(cfg)}
    SELECT {R('total_revenue', 2)} AS total_revenue, total_orders, unique_customers,
           {R('avg_order_value', 2)} AS avg_order_value, {R('median_order_value', 2)} AS median_order_value,
           active_categories, top_category, pareto_categories,
           {R('avg_delivery_days', 2)} AS avg_delivery_days,
           {R('median_delivery_days', 2)} AS median_delivery_days,
           {R('late_delivery_rate', 2)} AS late_delivery_rate,
           {R('avg_handling_days', 2)} AS avg_handling_days,
           {R('avg_transit_days', 2)} AS avg_transit_days,
           {R('avg_review_score', 3)} AS avg_review_score, {R('five_star_rate', 2)} AS five_star_rate,
           {R('one_star_rate', 2)} AS one_star_rate,
           {R('delay_review_spearman', 4)} AS delay_review_spearman
    FROM k"""


@oracle("kpi_summary_table")
def kpi_summary_table(cfg):
    def f(c, d):
        return f"format('{{:,.{d}f}}', {R(c, d)})"
    rows = [
        ("Total Revenue", f"'R$ ' || {f('total_revenue', 2)}"),
        ("Total Orders", "format('{:,}', total_orders)"),
        ("Unique Customers", "format('{:,}', unique_customers)"),
        ("Avg Order Value", f"'R$ ' || {f('avg_order_value', 2)}"),
        ("Avg Delivery Days", f"{f('avg_delivery_days', 1)} || ' days'"),
        ("Late Delivery Rate", f"{f('late_delivery_rate', 1)} || '%'"),
        ("Avg Review Score", f('avg_review_score', 2)),
        ("5-Star Rate", f"{f('five_star_rate', 1)} || '%'"),
        ("1-Star Rate", f"{f('one_star_rate', 1)} || '%'"),
        ("Delay-Review Correlation", f"'ρ = ' || {f('delay_review_spearman', 3)}"),
    ]
    body = " UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value FROM k" for m, v in rows)
    return f"WITH {_kpi_ctes(cfg)} {body}"
