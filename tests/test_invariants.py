"""Invariants on the driver tables (sf0.001), and the p-value queries that
have no SQL oracle, checked against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.catalog import QUERIES
from test_stats import t_tail


def test_revenue_is_conserved(tables):
    month = sum(r["revenue"] for r in QUERIES["monthly_trend_frame"](tables).collect())
    cat = sum(r["revenue"] for r in QUERIES["category_performance"](tables).collect())
    kpi = QUERIES["executive_kpis"](tables).first()
    assert month == pytest.approx(cat) == pytest.approx(kpi["total_revenue"], abs=0.01)
    orders = sum(r["order_count"] for r in QUERIES["monthly_trend_frame"](tables).collect())
    assert orders == kpi["total_orders"]
    cat_orders = sum(r["orders"] for r in QUERIES["category_performance"](tables).collect())
    assert cat_orders >= orders


def test_shares_sum_to_100(tables):
    for name, col in (("review_distribution", "pct"), ("order_status_dist", "pct"),
                      ("estimate_accuracy_bands", "pct")):
        total = sum(r[col] for r in QUERIES[name](tables).collect())
        assert total == pytest.approx(100.0, abs=0.5), name


def test_handling_plus_transit_is_delivery(tables):
    d = tables.delivered.where(F.col("handling_days").isNotNull() & F.col("transit_days").isNotNull())
    worst = d.agg(F.max(F.abs(F.col("handling_days") + F.col("transit_days")
                              - F.col("delivery_days")))).first()[0]
    assert worst is None or worst < 1e-9


def test_item_view_rows(tables):
    o = tables.orders_window.select("order_id", "customer_id")
    expected = (tables["order_items"].join(o, "order_id")
                .join(tables["customers"].select("customer_id"), "customer_id").count())
    assert tables.item_view.count() == expected


def test_summary_one_row_per_order(tables):
    s = tables.orders_summary
    assert s.count() == s.select("order_id").distinct().count()


def _brute_spearman(pdf, x, y):
    d = pdf[[x, y]].dropna()
    rho = d[x].rank().corr(d[y].rank())
    n = len(d)
    return rho, t_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def test_delay_spearman_test_against_brute_force(tables):
    pdf = tables.reviewed_delivered.select("delay_days", "review_score").toPandas()
    rho, p = _brute_spearman(pdf, "delay_days", "review_score")
    r = QUERIES["delay_spearman_test"](tables).first()
    assert r["rho"] == pytest.approx(rho, abs=1e-6)
    assert r["p_value"] == pytest.approx(p, rel=1e-3)


def test_installment_spearman_test_against_brute_force(tables):
    cc = tables.orders_summary.where(F.col("primary_payment_type") == "credit_card")
    pdf = cc.select("primary_installments", F.col("order_revenue").cast("double")).toPandas()
    rho, p = _brute_spearman(pdf, "primary_installments", "order_revenue")
    r = QUERIES["installment_spearman_test"](tables).first()
    assert r["rho"] == pytest.approx(rho, abs=1e-6)
    assert r["p_value"] == pytest.approx(p, rel=1e-3)


def test_mann_whitney_route_test_against_brute_force(tables):
    from cargolens.operators.delivery import route_type
    d = tables.item_view.where(F.col("delivery_days").isNotNull())
    pdf = d.select("delivery_days", route_type().alias("r")).toPandas()
    a = pdf.loc[pdf.r == "Same State", "delivery_days"].values
    b = pdf.loc[pdf.r != "Same State", "delivery_days"].values
    u1 = sum(((ai > b).sum() + 0.5 * (ai == b).sum()) for ai in a)
    r = QUERIES["mann_whitney_route_test"](tables).first()
    assert r["u_statistic"] == pytest.approx(u1)
    n1, n2 = len(a), len(b)
    ties = np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float)
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    assert r["p_value"] == pytest.approx(0.5 * math.erfc((n1 * n2 / 2 - u1 - 0.5) / sigma / math.sqrt(2)), abs=2e-9)


def test_aov_trend_significance(tables):
    import numpy as np
    m = QUERIES["monthly_trend_frame"](tables).orderBy("order_month").toPandas()
    x = np.arange(len(m), dtype=float)
    y = m["avg_order_value"].values
    r = np.corrcoef(x, y)[0, 1]
    t = r * math.sqrt((len(m) - 2) / (1 - r * r))
    got = QUERIES["aov_trend_significance"](tables).first()
    assert got["p_value"] == pytest.approx(t_tail(t, len(m) - 2), abs=2e-9)
    assert got["significant"] == (got["p_value"] < 0.05)


def test_spearman_drivers_test_has_all_measures(tables):
    from cargolens.operators.satisfaction import DRIVER_MEASURES
    pdf = tables.reviewed_delivered.select("review_score", *[F.col(c).cast("double") for c in DRIVER_MEASURES]).toPandas().dropna()
    rows = QUERIES["spearman_drivers_test"](tables).collect()
    assert len(rows) == 8
    for r in rows:
        rho, p = _brute_spearman(pdf, r["x"], "review_score")
        assert r["rho"] == pytest.approx(rho, abs=1e-6) and r["p_value"] == pytest.approx(p, abs=2e-9)
