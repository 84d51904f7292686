"""Cleaning and model rules on hand-made raw tables (FIXTURES.md §1 plants)."""

import datetime as dt
from decimal import Decimal

import pytest

from cargolens.config import Config
from cargolens.operators import clean, model
from cargolens.plans.tables import Tables
from cargolens.sources.schemas import LONG_KEYS

T = dt.datetime


def frame(spark, table, rows):
    schema = LONG_KEYS[table]
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_reviews_latest_answer_then_higher_score_then_id(spark):
    r = frame(spark, "reviews", [
        dict(review_id=1, order_id=10, review_score=2, review_answer_timestamp=T(2018, 1, 2)),
        dict(review_id=2, order_id=10, review_score=4, review_answer_timestamp=T(2018, 1, 2),
             review_comment_message="ok"),
        dict(review_id=3, order_id=10, review_score=5, review_answer_timestamp=T(2018, 1, 1)),
        dict(review_id=4, order_id=20, review_score=1, review_answer_timestamp=None),
        dict(review_id=5, order_id=20, review_score=3, review_answer_timestamp=T(2017, 1, 1)),
        dict(review_id=6, order_id=30, review_score=3, review_answer_timestamp=T(2017, 1, 1)),
        dict(review_id=7, order_id=30, review_score=3, review_answer_timestamp=T(2017, 1, 1)),
    ])
    out = by(clean.reviews_clean(r), "order_id")
    assert out[10]["review_id"] == 2 and out[10]["has_comment"] is True
    assert out[20]["review_id"] == 5          # NULL answer time sorts last
    assert out[30]["review_id"] == 7          # full tie: higher id
    chk = clean.reviews_clean_check(clean.reviews_clean(r)).first()
    assert chk["should_be_zero"] == 0
    # idempotent
    again = clean.reviews_clean(clean.reviews_clean(r).drop("has_comment"))
    assert again.count() == 3


def test_translation_fix_only_adds_absent_keys(spark):
    tr = frame(spark, "category_translation", [
        dict(product_category_name="a", product_category_name_english="A"),
        dict(product_category_name="pc_gamer", product_category_name_english="keep"),
    ])
    fixed = by(clean.translation_fixed(spark, tr, Config()), "product_category_name")
    assert fixed["pc_gamer"]["product_category_name_english"] == "keep"
    assert (fixed["portateis_cozinha_e_preparadores_de_alimentos"]["product_category_name_english"]
            == "portable_kitchen_food_processors")
    assert len(fixed) == 3


def test_products_size_tiers_unknowns_and_volume(spark):
    weights = [0, 500, 501, 2000, 10000, 10001, None]
    p = frame(spark, "products", [
        dict(product_id=i, product_category_name=("a" if i < 3 else ("zz" if i < 6 else None)),
             product_weight_g=w, product_length_cm=2, product_height_cm=3,
             product_width_cm=(None if i == 0 else 4), product_name_lenght=7)
        for i, w in enumerate(weights)])
    tr = frame(spark, "category_translation",
               [dict(product_category_name="a", product_category_name_english="A")])
    out = by(clean.products_clean(p, tr), "product_id")
    tiers = [out[i]["product_size_tier"] for i in range(len(weights))]
    assert tiers == ["small", "small", "medium", "medium", "large", "extra_large", "unknown"]
    assert out[1]["product_category_english"] == "A"
    assert out[4]["product_category_english"] == "unknown"           # untranslated
    assert out[6]["product_category_name"] == "unknown"              # NULL category
    assert out[0]["product_volume_cm3"] is None and out[1]["product_volume_cm3"] == 24
    assert out[1]["product_name_length"] == 7


def test_orders_delivery_metrics_and_guards(spark):
    base = dict(order_purchase_timestamp=T(2018, 1, 1), order_approved_at=T(2018, 1, 1, 12),
                order_delivered_carrier_date=T(2018, 1, 3),
                order_estimated_delivery_date=T(2018, 1, 11))
    o = frame(spark, "orders", [
        dict(base, order_id=1, customer_id=1, order_status="delivered",
             order_delivered_customer_date=T(2018, 1, 11)),                 # exactly on time
        dict(base, order_id=2, customer_id=2, order_status="delivered",
             order_delivered_customer_date=T(2018, 1, 11, 0, 0, 1)),        # one second late
        dict(base, order_id=3, customer_id=3, order_status="delivered",
             order_delivered_customer_date=None),                          # delivered, no date
        dict(base, order_id=4, customer_id=4, order_status="shipped",
             order_delivered_customer_date=T(2018, 1, 5)),
    ])
    out = by(clean.orders_clean(o), "order_id")
    assert out[1]["is_late"] is False and out[1]["delay_days"] == 0.0
    assert out[1]["delivery_days"] == 10.0 and out[1]["handling_days"] == 2.0
    assert out[1]["transit_days"] == 8.0 and out[1]["processing_days"] == 1.5
    assert out[1]["approval_hours"] == 12.0 and out[1]["estimated_delivery_days"] == 10.0
    assert out[2]["is_late"] is True and out[2]["delay_days"] > 0
    assert out[3]["delivery_days"] is None and out[3]["is_late"] is False
    assert out[3]["transit_days"] is None
    # not delivered: no delivery metrics, but transit follows the SQL rule
    assert out[4]["delivery_days"] is None and out[4]["transit_days"] == 2.0
    assert out[1]["order_day_of_week"] == 1 and out[1]["order_dow"] == 0  # a Monday
    assert out[1]["order_month"] == dt.date(2018, 1, 1)


def test_payments_flags_and_primary(spark):
    p = frame(spark, "payments", [
        dict(order_id=1, payment_sequential=1, payment_type="voucher", payment_installments=1,
             payment_value=Decimal("50.00")),
        dict(order_id=1, payment_sequential=2, payment_type="credit_card", payment_installments=6,
             payment_value=Decimal("50.00")),                                # tie: lower seq wins
        dict(order_id=1, payment_sequential=3, payment_type="boleto", payment_installments=9,
             payment_value=Decimal("0.00")),                                 # anomaly: zero
        dict(order_id=2, payment_sequential=1, payment_type="not_defined", payment_installments=1,
             payment_value=Decimal("10.00")),                                # anomaly: type
    ])
    pc = clean.payments_clean(p)
    assert sum(r["is_anomaly"] for r in pc.collect()) == 2
    agg = by(clean.payments_order_agg(pc), "order_id")
    assert set(agg) == {1}
    a = agg[1]
    assert a["primary_payment_type"] == "voucher" and a["primary_installments"] == 1
    assert a["max_installments"] == 6 and a["payment_count"] == 2
    assert a["total_payment_value"] == Decimal("100.00") and a["is_multi_payment"] is True


def test_geolocation_mode_ties_to_smallest(spark):
    g = frame(spark, "geolocation", [
        dict(geolocation_zip_code_prefix=1, geolocation_lat=1.0, geolocation_lng=2.0,
             geolocation_city="b", geolocation_state="X"),
        dict(geolocation_zip_code_prefix=1, geolocation_lat=2.0, geolocation_lng=4.0,
             geolocation_city="a", geolocation_state="X"),
    ])
    r = clean.geolocation_clean(g).first()
    assert r["city"] == "a" and r["avg_lat"] == 1.5 and r["point_count"] == 2


def _mini_tables(spark):
    cfg = Config()
    orders = []
    for oid, ts in ((1, T(2017, 1, 1)), (2, T(2018, 8, 31, 23, 59, 59)), (3, T(2016, 12, 31, 23, 59, 59)),
                    (4, T(2018, 9, 1)), (5, T(2017, 6, 1)), (6, T(2017, 6, 2))):
        orders.append(dict(order_id=oid, customer_id=oid, order_status="delivered",
                           order_purchase_timestamp=ts, order_estimated_delivery_date=ts))
    items = [dict(order_id=o, order_item_id=1, product_id=1, seller_id=1,
                  price=Decimal("10.00"), freight_value=Decimal("2.00")) for o in (1, 2, 3, 4)]
    items.append(dict(order_id=1, order_item_id=2, product_id=2, seller_id=1,
                      price=Decimal("5.00"), freight_value=Decimal("1.00")))
    items.append(dict(order_id=6, order_item_id=1, product_id=1, seller_id=1,
                      price=Decimal("0.00"), freight_value=Decimal("3.00")))   # zero price
    customers = [dict(customer_id=o, customer_unique_id=100 + (o % 2), customer_state="S")
                 for o in range(1, 7)]
    raw = {
        "orders": frame(spark, "orders", orders),
        "order_items": frame(spark, "order_items", items),
        "customers": frame(spark, "customers", customers),
        "payments": frame(spark, "payments", []),
        "reviews": frame(spark, "reviews", []),
        "products": frame(spark, "products", [dict(product_id=1), dict(product_id=2)]),
        "sellers": frame(spark, "sellers", [dict(seller_id=1, seller_state="S")]),
        "category_translation": frame(spark, "category_translation", []),
        "geolocation": frame(spark, "geolocation", []),
    }
    return Tables(spark, raw, cfg)


def test_window_boundaries_and_summary(spark):
    t = _mini_tables(spark)
    s = by(t.orders_summary, "order_id")
    # first instant in, last instant in; the instants either side out; no items out
    assert set(s) == {1, 2, 6}
    assert s[1]["item_count"] == 2 and s[1]["unique_products"] == 2
    assert s[1]["order_revenue"] == Decimal("15.00") and s[1]["order_total"] == Decimal("18.00")
    assert s[1]["freight_pct"] == pytest.approx(20.0)
    assert s[6]["freight_pct"] is None                   # zero price: no ratio, no error
    assert t.item_view.count() == 4
    assert model.orders_summary_check(t.orders_summary).first()["total_orders"] == 3


def test_materialize_round_trip(spark, tmp_path):
    t = _mini_tables(spark)
    m = t.materialize(str(tmp_path / "model"), names=("orders_summary", "item_view"))
    assert sorted(r["order_id"] for r in m.orders_summary.collect()) == [1, 2, 6]
    assert m.item_view.count() == 4
