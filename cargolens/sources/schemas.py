"""Explicit schemas of the nine raw marketplace tables (never inferSchema).

Column names follow the published data dictionary, including its two
misspelt product columns, which the cleaning step renames. Keys are strings
in the published CSV files; the adapter over the driver tables keeps the
driver's 64-bit integer keys instead (cheaper to hash, shuffle and join), and
nothing downstream depends on the key type.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


def raw_schemas(key_type=StringType()) -> dict[str, StructType]:
    k = key_type
    ts = TimestampNTZType()
    return {
        "orders": _s(
            ("order_id", k), ("customer_id", k), ("order_status", StringType()),
            ("order_purchase_timestamp", ts), ("order_approved_at", ts),
            ("order_delivered_carrier_date", ts), ("order_delivered_customer_date", ts),
            ("order_estimated_delivery_date", ts)),
        "order_items": _s(
            ("order_id", k), ("order_item_id", IntegerType()), ("product_id", k),
            ("seller_id", k), ("shipping_limit_date", ts), ("price", MONEY),
            ("freight_value", MONEY)),
        "customers": _s(
            ("customer_id", k), ("customer_unique_id", k),
            ("customer_zip_code_prefix", IntegerType()), ("customer_city", StringType()),
            ("customer_state", StringType())),
        "payments": _s(
            ("order_id", k), ("payment_sequential", IntegerType()),
            ("payment_type", StringType()), ("payment_installments", IntegerType()),
            ("payment_value", MONEY)),
        "reviews": _s(
            ("review_id", k), ("order_id", k), ("review_score", IntegerType()),
            ("review_comment_title", StringType()), ("review_comment_message", StringType()),
            ("review_creation_date", ts), ("review_answer_timestamp", ts)),
        "products": _s(
            ("product_id", k), ("product_category_name", StringType()),
            ("product_name_lenght", IntegerType()), ("product_description_lenght", IntegerType()),
            ("product_photos_qty", IntegerType()), ("product_weight_g", IntegerType()),
            ("product_length_cm", IntegerType()), ("product_height_cm", IntegerType()),
            ("product_width_cm", IntegerType())),
        "sellers": _s(
            ("seller_id", k), ("seller_zip_code_prefix", IntegerType()),
            ("seller_city", StringType()), ("seller_state", StringType())),
        "category_translation": _s(
            ("product_category_name", StringType()),
            ("product_category_name_english", StringType())),
        "geolocation": _s(
            ("geolocation_zip_code_prefix", IntegerType()), ("geolocation_lat", DoubleType()),
            ("geolocation_lng", DoubleType()), ("geolocation_city", StringType()),
            ("geolocation_state", StringType())),
    }


RAW_TABLES = ("orders", "order_items", "customers", "payments", "reviews", "products",
              "sellers", "category_translation", "geolocation")

LONG_KEYS = raw_schemas(LongType())
