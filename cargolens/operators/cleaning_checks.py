"""The cleaned and modelled tables, and the reference's inline checks, as
registered queries. Money columns are projected as double, so the outputs
compare across engines without decimal-precision noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from . import clean, model

VIEW_COLS = ("order_id", "order_item_id", "product_id", "seller_id", "order_status",
             "order_purchase_timestamp", "order_month", "order_week", "order_year",
             "order_quarter", "order_month_num", "order_day_of_week", "order_hour",
             "delivery_days", "delay_days", "is_late", "handling_days", "transit_days",
             "approval_hours", "estimated_delivery_days", "customer_unique_id", "customer_city",
             "customer_state", "customer_zip_code_prefix", "price", "freight_value",
             "total_item_value", "product_category_name", "product_category_english",
             "product_weight_g", "product_volume_cm3", "product_size_tier", "seller_city",
             "seller_state", "seller_zip_code_prefix", "review_score", "has_comment",
             "review_comment_message", "primary_payment_type", "max_installments",
             "total_payment_value", "is_multi_payment")

SUMMARY_COLS = ("order_id", "order_status", "order_purchase_timestamp", "order_month",
                "order_week", "order_year", "order_quarter", "order_month_num",
                "order_day_of_week", "order_hour", "delivery_days", "handling_days",
                "transit_days", "delay_days", "is_late", "estimated_delivery_days",
                "customer_unique_id", "customer_state", "customer_city", "item_count",
                "unique_products", "unique_sellers", "order_revenue", "order_freight",
                "order_total", "freight_pct", "primary_payment_type", "max_installments",
                "total_payment_value", "is_multi_payment", "review_score", "has_comment")

MONEY = {"price", "freight_value", "total_item_value", "total_payment_value", "order_revenue",
         "order_freight", "order_total", "payment_value"}


def project(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in MONEY else F.col(c) for c in cols])


@query("translation_fixed")
def translation_fixed(t) -> DataFrame:
    """Category translation with the configured missing entries added."""
    return t.translation


@query("translation_count")
def translation_count(t) -> DataFrame:
    """Rows of the fixed translation table."""
    return clean.translation_count(t.translation)


@query("reviews_clean")
def reviews_clean(t) -> DataFrame:
    """One review per order (latest answer, then score, then id)."""
    return t.reviews_clean


@query("reviews_clean_check")
def reviews_clean_check(t) -> DataFrame:
    """Reviews, distinct orders and their difference (should be zero)."""
    return clean.reviews_clean_check(t.reviews_clean)


@query("products_clean")
def products_clean(t) -> DataFrame:
    """Products with English category, fixed column names, volume and size tier."""
    return t.products_clean


@query("products_untranslated_check")
def products_untranslated_check(t) -> DataFrame:
    """Products whose category stays 'unknown'."""
    return clean.products_untranslated_check(t.products_clean)


@query("orders_clean")
def orders_clean(t) -> DataFrame:
    """Orders with calendar columns and guarded delivery metrics."""
    return t.orders_clean


@query("orders_clean_check")
def orders_clean_check(t) -> DataFrame:
    """Totals, mean delivery/handling/transit/delay days, late count and share."""
    return clean.orders_clean_check(t.orders_clean)


@query("payments_clean")
def payments_clean(t) -> DataFrame:
    """Payments with the anomaly flag."""
    return project(t.payments_clean, t.payments_clean.columns)


@query("payments_order_agg")
def payments_order_agg(t) -> DataFrame:
    """Per order, non-anomalous payments: count, primary type, installments, total, methods."""
    return project(t.payments_order_agg, t.payments_order_agg.columns)


@query("geolocation_clean")
def geolocation_clean(t) -> DataFrame:
    """Zip-prefix centroids with modal city and state."""
    return t.geolocation_clean


@query("orders_item_view")
def orders_item_view(t) -> DataFrame:
    """The item-level analysis view (window orders with a customer)."""
    return project(t.item_view, VIEW_COLS)


@query("orders_summary")
def orders_summary(t) -> DataFrame:
    """The order-level summary (window orders with items)."""
    return project(t.orders_summary, SUMMARY_COLS)


@query("orders_summary_check")
def orders_summary_check(t) -> DataFrame:
    """Orders, average order value, mean delivery days and review score."""
    return model.orders_summary_check(t.orders_summary)
