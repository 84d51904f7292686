"""Subtotals, multisets, grouped medians, documents and sketches against plain versions."""

import contextlib
import io
import random
from collections import Counter
from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.catalog import QUERIES
from cargolens.functions import grains, multisets, stats
from cargolens.operators import grouping


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def sales(n, seed=1):
    """(a, b, who, amount): a third of the rows is one customer's; dimensions and customers may be null."""
    rnd = random.Random(seed)
    return [(rnd.choice(["x", "y", None]), rnd.choice([1, 2, 3, None]), 7 if i % 3 == 0 else rnd.choice([None, *range(20)]), Decimal(rnd.randrange(1000)) / 100)
            for i in range(n)]


@pytest.mark.parametrize("kind", ["cube", "rollup", "sets"])
def test_grouping_sets(spark, kind):
    rows = sales(500)
    df = spark.createDataFrame(rows, "a string, b int, who long, amount decimal(10,2)").repartition(4)
    sets = {"cube": grains.cube_sets(["a", "b"]), "rollup": grains.rollup_sets(["a", "b"]), "sets": [("b",), ("a", "b")]}[kind]
    got = grains.grouping_sets(df, ["a", "b"], sets, {"n": F.lit(1), "amount": F.col("amount")}, "who", "people")
    want = {}
    for s in sets:
        for a, b, who, amount in rows:
            key = (a if "a" in s else None, b if "b" in s else None, ("a" not in s) * 2 + ("b" not in s))
            g = want.setdefault(key, [0, Decimal(0), set()])
            g[0], g[1] = g[0] + 1, g[1] + amount
            g[2] |= {who} - {None}
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*k, n, s, len(p)) for k, (n, s, p) in want.items()], key=str)
    assert got.schema["amount"].dataType.simpleString() == "decimal(20,2)"
    lines = plan(got).splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert any("HashAggregate" in line for line in lines[expand:])  # rows are added up before they are laid out for the sets
    assert grains.cube_sets(["a", "b", "c"])[0] == ("a", "b", "c") and len(grains.cube_sets("abc")) == 8
    assert {tuple(c) for n in range(4) for c in combinations("abc", n)} == set(grains.cube_sets("abc"))


def test_grouping_sets_of_no_rows(spark):
    df = spark.createDataFrame([], "a string, b int, who long, amount decimal(10,2)")
    assert grains.grouping_sets(df, ["a", "b"], [("a",)], {"n": F.lit(1)}, "who", "people").isEmpty()


def test_multisets(spark):
    rnd = random.Random(3)

    def some(n):
        return [(rnd.choice([None, 1, 2]), rnd.choice(["p", "q", None])) for _ in range(n)] + [(9, "many")] * (n * 20)

    a, b = some(120), some(70) + [(5, "only here")]
    da, db = (spark.createDataFrame(x, "k int, v string") for x in (a, b))
    ca, cb = Counter(a), Counter(b)

    def got(df):
        assert df.columns == ["k", "v"]
        return Counter(map(tuple, df.collect()))

    assert got(multisets.intersect(da, db, every=True)) == ca & cb
    assert got(multisets.subtract(da, db, every=True)) == ca - cb
    assert got(multisets.intersect(da, db)) == Counter(set(a) & set(b))
    assert got(multisets.subtract(db, da)) == Counter(set(b) - set(a))
    for mine, theirs in ((multisets.intersect(da, db, every=True), da.intersectAll(db)), (multisets.subtract(da, db, every=True), da.exceptAll(db))):
        assert got(mine) == Counter(map(tuple, theirs.collect()))
    assert got(multisets.subtract(da, da, every=True)) == Counter()


def test_changes(spark):
    schema = "id long, v string, w decimal(6,2)"
    old = [(1, "a", Decimal(1)), (1, "a", Decimal(1)), (2, "b", None), (3, "c", Decimal(3)), (4, "same", Decimal(4)), (None, "n", Decimal(0)), (6, "x", None), (6, "x", None)]
    new = [(1, "a", Decimal(1)), (2, "b", Decimal(2)), (5, "new", None), (5, "new", None), (4, "same", Decimal(4)), (None, "n", Decimal(1)), (6, "x", None), (6, "x", None)]
    got = multisets.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).select("w", "id", "v"), ["id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "changed", 1, 0), (2, "changed", 1, 1), (3, "removed", 1, 0), (5, "added", 0, 2), (None, "changed", 1, 1)], key=str)


def test_sides_partitioned_alike_are_not_one_task(spark):
    """Rows are counted where their side is made and dealt out anew: no task holds both sides and what counts them."""
    def side(status, n):
        return spark.range(n).select(F.pmod("id", F.lit(90)).alias("id"), F.lit(status).alias("v")).repartition(6, "id")

    old, new = side("a", 270), side("b", 180)
    for df in (multisets.changes(old, new, ["id"]), multisets.intersect(old, new), multisets.subtract(old, new)):
        lines = plan(df).splitlines()
        above = lines[:next(i for i, line in enumerate(lines) if "Union" in line)]
        dealt = max(i for i, line in enumerate(above) if "Exchange hashpartitioning" in line)
        assert any("HashAggregate" in line and "partial" in line for line in above[dealt:])
    got = multisets.changes(old, new, ["id"])
    assert got.groupBy("change", "rows_removed", "rows_added").count().collect() == [("changed", 3, 2, 90)]


def test_rows_of_different_types_count_as_the_wider(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 2), (3, None)], "k int, `v.w` int"), spark.createDataFrame([(1, 2), (3, None), (1 << 40, 5)], "key long, v long")
    got = multisets.subtract(a, b, every=True)
    assert got.columns == ["k", "v.w"] and [t for _, t in got.dtypes] == ["bigint", "bigint"] and list(map(tuple, got.collect())) == [(1, 2)]
    assert sorted(map(tuple, multisets.intersect(a, b).collect())) == [(1, 2), (3, None)]


def test_grouped_quantile(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else "cold", float(x)) for i, x in enumerate(rng.normal(0, 30, 900).round(1))] + [("none", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in stats.grouped_quantile(df, ["g"], "x", p, "q").collect()}
        want = {g: np.quantile([x for h, x in rows if h == g and x is not None], p) for g in (None, "hot", "cold", "one")}
        assert got == pytest.approx(want)


def test_slowest_orders_need_no_nested_loop(tables):
    p = plan(QUERIES["seller_slowest_orders"](tables))
    loops = [line for line in p.splitlines() if "NestedLoop" in line or "Cartesian" in line]
    assert all("n_orders" in line for line in loops) and "WindowGroupLimit" in p


def test_documents_in_parts(spark):
    """An order with a third of all lines is many records, none of them large; totals add up over them."""
    n = 900
    items = spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("long").alias("order_id"),
                                  F.when(F.col("id") % 3 == 0, F.col("id") / 3 + 1).otherwise(1).cast("int").alias("order_item_id"),
                                  F.col("id").alias("product_id"), (F.col("id") % 4).alias("seller_id"), F.lit(Decimal("1.50")).cast("decimal(18,2)").alias("price"),
                                  F.lit(Decimal("0.25")).cast("decimal(18,2)").alias("freight_value"))
    payments = spark.createDataFrame([(1, 1, 'say "hi"\n', 3, Decimal("9.99")), (5, 1, None, 1, None)],
                                     "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18,2)")
    docs = grouping.order_documents(items, payments)
    sizes = {(r.order_id, r.part): r.n for r in docs.selectExpr("order_id", "part", "size(doc.items) AS n").collect()}
    assert max(sizes.values()) == 100 and sizes[1, 0] == sizes[1, 2] == 100 and (5, 0) in sizes and sizes[5, 0] == 0
    totals = {r.order_id: r for r in QUERIES["order_document_totals"]({"order_items": items, "payments": payments}).collect()}
    hot = totals[1]
    assert (hot["items"], hot.payments, hot.price, hot.freight, hot.paid, hot.payment_types, hot.json_same) == (300, 1, 450.0, 75.0, 9.99, 'say "hi"\n', True)
    assert totals[5].payment_types == "" and totals[5].paid == 0.0 and totals[5].json_same and len(totals) == 602


def test_sketches_against_the_exact_queries(tables, tmp_path):
    """Stored monthly, merged later: customers within 5 %, quantiles within 3 % of the ranks."""
    grouping.monthly_sketches(tables).write.parquet(str(tmp_path / "s"))
    stored = tables.spark.read.parquet(str(tmp_path / "s"))
    s = tables.orders_summary.select("order_month", "customer_unique_id", "delivery_days").collect()
    for period, of in ((F.trunc("order_month", "quarter"), lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1)), (F.lit("all"), lambda d: "all")):
        got = {r.period: r for r in grouping.merged_sketches(stored, period).collect()}
        for p in {of(r.order_month) for r in s}:
            rows = [r for r in s if of(r.order_month) == p]
            people, days = {r.customer_unique_id for r in rows}, sorted(r.delivery_days for r in rows if r.delivery_days is not None)
            assert abs(got[p].customers - len(people)) <= max(1, 0.05 * len(people))
            for q, value in ((0.5, got[p].median_days), (0.9, got[p].p90_days)):
                below, upto = (sum(x < value for x in days) / len(days), sum(x <= value for x in days) / len(days))
                assert below - 0.03 - 1 / len(days) <= q <= upto + 0.03 + 1 / len(days)
    assert sorted(map(str, QUERIES["sketched_quarters"](tables).collect()))
