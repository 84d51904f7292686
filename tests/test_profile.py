"""Generic profiling operators on hand-made frames."""

from decimal import Decimal

from cargolens.operators import profile
from cargolens.sources.schemas import LONG_KEYS


def frame(spark, table, rows):
    schema = LONG_KEYS[table]
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_orphans_count_null_keys_and_duplicates_once(spark):
    orders = frame(spark, "orders", [dict(order_id=1), dict(order_id=2), dict(order_id=3)])
    items = frame(spark, "order_items", [dict(order_id=1, order_item_id=1),
                                         dict(order_id=1, order_item_id=2),
                                         dict(order_id=9, order_item_id=1),
                                         dict(order_id=None, order_item_id=1)])
    a = profile.orphans(orders, "order_id", items, "order_id", "orders without items").first()
    b = profile.orphans(items, "order_id", orders, "order_id", "items without order").first()
    assert a["affected_rows"] == 2          # orders 2 and 3
    assert b["affected_rows"] == 2          # item of order 9 and the NULL-keyed item


def test_null_scan_lists_only_columns_with_nulls(spark):
    p = frame(spark, "payments", [
        dict(order_id=1, payment_sequential=1, payment_type="boleto", payment_value=Decimal("1.00")),
        dict(order_id=2, payment_sequential=1, payment_type=None, payment_value=Decimal("2.00")),
    ])
    rows = {r["column"]: (r["nulls"], r["pct"]) for r in profile.null_scan(p, "payments").collect()}
    assert rows == {"payment_type": (1, 50.0), "payment_installments": (2, 100.0)}


def test_key_uniqueness_and_shares(spark):
    s = frame(spark, "sellers", [dict(seller_id=1, seller_state="A"), dict(seller_id=1, seller_state="A"),
                                 dict(seller_id=2, seller_state="B")])
    u = profile.key_uniqueness(s, "seller_id", "sellers").first()
    assert (u["total"], u["uniq"], u["dups"]) == (3, 2, 1)
    top = profile.top_share(s, "seller_state", "sellers", 1).collect()
    assert [(r["seller_state"], r["sellers"], r["pct"]) for r in top] == [("A", 2, 66.7)]


def test_null_counts_names(spark):
    o = frame(spark, "orders", [dict(order_id=1, order_status="delivered"), dict(order_id=2)])
    r = profile.null_counts(o, {"order_status": "null_status", "order_approved_at": "null_approved"}).first()
    assert (r["total"], r["null_status"], r["null_approved"]) == (2, 1, 2)
