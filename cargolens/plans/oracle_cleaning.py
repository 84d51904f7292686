"""Oracle SQL (DuckDB) for the cleaned and modelled tables and the checks."""

from __future__ import annotations

from ..catalog import oracle
from ..operators.cleaning_checks import MONEY, SUMMARY_COLS, VIEW_COLS
from .oracle_base import AVGX, PCT, R


def _project(src: str, cols) -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY else c for c in cols)
    return f"SELECT {sel} FROM {src}"


@oracle("translation_fixed")
def translation_fixed(cfg):
    return "SELECT * FROM translation_fixed"


@oracle("translation_count")
def translation_count(cfg):
    return "SELECT COUNT(*) AS translation_count FROM translation_fixed"


@oracle("reviews_clean")
def reviews_clean(cfg):
    return "SELECT * FROM reviews_clean"


@oracle("reviews_clean_check")
def reviews_clean_check(cfg):
    return """
    SELECT COUNT(*) AS total_reviews, COUNT(DISTINCT order_id) AS unique_orders,
           COUNT(*) - COUNT(DISTINCT order_id) AS should_be_zero
    FROM reviews_clean"""


@oracle("products_clean")
def products_clean(cfg):
    return "SELECT * FROM products_clean"


@oracle("products_untranslated_check")
def products_untranslated_check(cfg):
    return """
    SELECT product_category_english, COUNT(*) AS products FROM products_clean
    WHERE product_category_english = 'unknown' GROUP BY 1"""


@oracle("orders_clean")
def orders_clean(cfg):
    return "SELECT * FROM orders_clean"


@oracle("orders_clean_check")
def orders_clean_check(cfg):
    has = "SUM(CASE WHEN delivery_days IS NOT NULL THEN 1 ELSE 0 END)"
    late = "SUM(CASE WHEN is_late THEN 1 ELSE 0 END)"
    return f"""
    SELECT COUNT(*) AS total_orders, CAST({has} AS BIGINT) AS has_delivery_time,
           {R('AVG(delivery_days)', 1)} AS avg_delivery_days,
           {R('AVG(handling_days)', 1)} AS avg_handling_days,
           {R('AVG(transit_days)', 1)} AS avg_transit_days,
           {R('AVG(delay_days)', 1)} AS avg_delay_days,
           CAST({late} AS BIGINT) AS late_count, {R(PCT(late, has), 1)} AS late_pct
    FROM orders_clean"""


@oracle("payments_clean")
def payments_clean(cfg):
    return _project("payments_clean", ("order_id", "payment_sequential", "payment_type",
                                       "payment_installments", "payment_value", "is_anomaly"))


@oracle("payments_order_agg")
def payments_order_agg(cfg):
    return _project("payments_order_agg", (
        "order_id", "payment_count", "primary_payment_type", "primary_installments",
        "max_installments", "total_payment_value", "payment_methods_used", "is_multi_payment"))


@oracle("geolocation_clean")
def geolocation_clean(cfg):
    return "SELECT * FROM geolocation_clean"


@oracle("orders_item_view")
def orders_item_view(cfg):
    return _project("vw_orders_analysis", VIEW_COLS)


@oracle("orders_summary")
def orders_summary(cfg):
    return _project("orders_summary", SUMMARY_COLS)


@oracle("orders_summary_check")
def orders_summary_check(cfg):
    return f"""
    SELECT COUNT(*) AS total_orders, {R(AVGX('order_revenue'), 2)} AS avg_order_value,
           {R('AVG(delivery_days)', 1)} AS avg_delivery_days,
           {R('AVG(review_score)', 2)} AS avg_review_score
    FROM orders_summary"""
