"""Physical-plan properties that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cargolens.catalog import QUERIES


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def model(tables, tmp_path_factory):
    return tables.materialize(str(tmp_path_factory.mktemp("model")), raw_names=("order_items",))


def test_materialized_scan_reads_only_needed_columns(model):
    p = plan(QUERIES["delivery_by_state"](model))
    schemas = [line for line in p.splitlines() if "ReadSchema" in line]
    assert schemas, p
    for s in schemas:
        assert "customer_city" not in s and "order_week" not in s


def test_month_filter_prunes_partitions(model):
    from pyspark.sql import functions as F
    df = model.orders_summary.where(F.col("order_month") == F.lit("1997-03-01").cast("date"))
    p = plan(df.groupBy("customer_state").count())
    assert "PartitionFilters: [isnotnull(order_month" in p


def test_summary_aggregates_items_before_the_join(tables):
    p = plan(tables.orders_summary)
    # partial aggregation of items sits below the exchange that feeds the join
    assert "HashAggregate" in p and "Expand" not in p
    # the join with the orders comes after the item aggregate, never a
    # 25-column grouping over joined item rows
    assert "Keys [25]" not in p


def test_the_summary_needs_no_window(tables):
    """Neither lines nor payments are numbered per order for it, so an order of a third of all rows is no single task."""
    assert "Window" not in plan(tables.orders_summary) and "Window" not in plan(tables.payments_order_agg)


def test_items_are_read_once_and_never_laid_out(model):
    from cargolens.operators.model import items_by_order
    p = plan(items_by_order(model["order_items"]))
    numbered = [line for line in p.splitlines() if line.startswith("(")]
    assert sum("Scan parquet" in line for line in numbered) == 1 and sum("Exchange" in line for line in numbered) == 3
    assert "Join" not in p and "Expand" not in p


def test_products_of_several_sellers(spark):
    """Different products and sellers of an order, with a product that three sellers sold, and null ids."""
    from decimal import Decimal

    from cargolens.operators.model import items_by_order
    one = Decimal("1.00")
    lines = [(1, 1, 5, 9), (1, 2, 5, 8), (1, 3, 5, 7), (1, 4, 6, 9), (1, 5, None, 9), (1, 6, 6, None), (1, 7, 5, 9), (2, 1, None, None)]
    items = spark.createDataFrame([(*x, one, one) for x in lines],
                                  "order_id long, order_item_id int, product_id long, seller_id long, price decimal(18,2), freight_value decimal(18,2)")
    got = {r.order_id: (r.item_count, r.unique_products, r.unique_sellers, r.order_revenue, r.order_total) for r in items_by_order(items).collect()}
    assert got == {1: (7, 2, 3, 7 * one, 14 * one), 2: (1, 0, 0, one, 2 * one)}


def test_review_dedupe_is_an_aggregate_not_a_window(tables):
    p = plan(tables.reviews_clean)
    assert "Window" not in p
    assert "partial_max" in p


def test_ranking_windows_are_partitioned(tables):
    # Values are ranked inside buckets; only the buckets' totals stand in one window.
    p = plan(QUERIES["delay_spearman"](tables))
    specs = [line for line in p.splitlines()
             if line.strip().startswith("Arguments:") and "windowspecdefinition" in line]
    assert specs
    for line in specs:
        assert "bkt" in line


def test_one_ranking_job_for_all_drivers(tables):
    """Nine columns and 81 pairs: the order summary is computed once, and read for the rows, the values and the
    buckets' totals (the latter two are one exchange at run time), not for each pair."""
    matrix = plan(QUERIES["spearman_matrix"](tables))
    assert "Scan parquet" not in matrix
    assert sum("Scan ExistingRDD" in line and line.startswith("(") for line in matrix.splitlines()) <= 3


def test_ranks_compute_what_they_read_of_the_summary(tables, monkeypatch):
    """Neither payments nor the numbers of different products and sellers, whose aggregates collect sets."""
    from cargolens.operators.report import KPI_COLUMNS
    from cargolens.operators.satisfaction import DRIVER_COLUMNS
    monkeypatch.setattr(type(tables), "kept", lambda t, df: df)
    for columns in (DRIVER_COLUMNS, KPI_COLUMNS):
        summary = tables.measured(*columns).orders_summary
        assert summary.columns == list(columns) and "collect_set" not in plan(summary)
    assert tables.measured("unique_sellers").orders_summary.columns == ["unique_sellers"]


def test_amounts_by_order(spark):
    """The same as the chain that also counts products and sellers, for lines that repeat or lack values."""
    from decimal import Decimal

    from cargolens.operators import model
    one, two = Decimal("1.10"), Decimal("2.25")
    rows = [(1, 1, 5, 7, one, two), (1, 1, 5, 7, one, two), (1, None, 5, 8, two, one), (1, 2, None, None, None, one), (2, 1, 5, None, two, None), (None, 1, 1, 1, one, one), (3, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "order_id long, order_item_id int, product_id long, seller_id long, price decimal(18,2), freight_value decimal(18,2)")
    short, long = model.amounts_by_order(items), model.items_by_order(items)
    assert sorted(map(str, short.collect())) == sorted(map(str, long.select(*short.columns).collect()))
    assert dict(short.dtypes) == {c: t for c, t in long.dtypes if c in short.columns}


def test_kpis_read_the_raw_tables_once(tables):
    p = plan(QUERIES["executive_kpis"](tables))
    reads = [line for line in p.splitlines() if line.startswith("(") and "Scan parquet" in line]
    assert len(reads) <= 14, reads  # the product figures alone use the item view


def test_monthly_sales_does_not_read_the_reviews(tables):
    from cargolens.operators import model
    enriched = model.orders_enriched(tables.orders_clean, tables["customers"], tables.reviews_clean,
                                     tables.payments_order_agg, tables.cfg)
    revenue = model.orders_summary(tables["order_items"], enriched).groupBy("order_month").agg(F.sum("order_revenue"))
    assert "events" not in plan(revenue)


def test_no_exchange_between_review_dedupe_and_its_join(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = tables["orders"].select("order_id", "order_status").repartition("order_id")
        p = plan(o.join(tables.reviews_clean, "order_id", "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one for the orders, one between the two halves of the aggregate
    assert sum("Exchange" in line and "hashpartitioning(order_id" in line for line in p.splitlines()) <= 2
