"""Spark queries against their DuckDB oracle on the driver tables (sf0.001).

A representative subset runs by default; CARGOLENS_FULL_ORACLE=1 runs every
registered query that has an oracle.
"""

import os

import pytest

from cargolens.plans.compare import compare_one
from cargolens.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"

SUBSET = (
    "monthly_sales", "yoy_growth", "repeat_customer_segments", "aov_trend_regression",
    "top_categories", "category_pareto", "size_tier_freight", "photo_bucket_reviews",
    "category_score_matrix", "delivery_dashboard", "delivery_by_seller_state",
    "estimate_accuracy_bands", "delivery_histograms", "mann_whitney_route",
    "review_distribution", "delay_buckets8", "star_profile", "spearman_drivers",
    "inspect_review_dups", "orphan_checks", "untranslated_categories", "price_distribution",
    "null_scan", "reviews_clean", "payments_order_agg", "geolocation_clean",
    "orders_item_view", "orders_summary", "freight_by_distance", "slowest_sellers",
    "buffer_whatif", "dim_customer", "dim_date", "kpi_summary_table",
)

_SQL = oracle_sql()
_Q = queries()
NAMES = sorted(_SQL) if os.environ.get("CARGOLENS_FULL_ORACLE") else SUBSET


def test_every_query_is_registered_with_sql_or_a_reason():
    missing = set(_Q) - set(_SQL)
    assert not missing


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    ok, n, _, _, detail = compare_one(spark, duck, name, _Q[name], _SQL[name], SF)
    assert ok, detail
