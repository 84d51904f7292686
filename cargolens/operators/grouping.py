"""Subtotals, changes between loads, rows next to their group's median, orders as documents, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import grains, multisets, stats

# Fixed values (ours; the oracle repeats them). The earlier load of a raw table, made from the present one by its order ids:
#   of 53 orders one was not there, of 59 one is there no longer; of 17 one had another status; of 29 one stood there twice
#   items and payments: of 31 orders one had prices or amounts one unit higher
NEW, GONE, RESTATED, TWICE, REPRICED = 53, 59, 17, 29, 31
SLOWEST = 3
#: Items or payments in one document of an order.
DOCUMENT_ROWS = 100
#: Size of the sketches: 2^LG_K registers; K items a level.
LG_K, K = 12, 200


@query("revenue_cube")
def revenue_cube(t) -> DataFrame:
    """Items, revenue and customers by month, customer state and category with all subtotals."""
    dims = ["order_month", "customer_state", "product_category_english"]
    out = grains.grouping_sets(t.item_view, dims, grains.cube_sets(dims), {"items": F.lit(1), "revenue": F.col("price")}, "customer_unique_id", "customers")
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("revenue_rollup")
def revenue_rollup(t) -> DataFrame:
    """Orders, revenue and customers by year, quarter and month with the subtotals of each year and quarter."""
    dims = ["order_year", "order_quarter", "order_month"]
    out = grains.grouping_sets(t.orders_summary, dims, grains.rollup_sets(dims), {"orders": F.lit(1), "revenue": F.col("order_revenue")},
                               "customer_unique_id", "customers")
    return out.withColumn("revenue", F.col("revenue").cast("double"))


# ------------------------------------------------------------ two loads --

def _every(n: int):
    return F.pmod(F.col("order_id"), F.lit(n)) == 0


def loads(t) -> dict[str, tuple[DataFrame, DataFrame, list[str]]]:
    """Earlier load, present load and key of three raw tables."""
    def earlier(df: DataFrame, changed: dict) -> DataFrame:
        old = df.where(~_every(NEW)).withColumns(changed).select(*df.columns)
        return old.withColumn("_n", F.explode(F.when(_every(TWICE), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")

    def dearer(c: str):
        return {c: F.when(_every(REPRICED), F.col(c) + 1).otherwise(F.col(c)).cast("decimal(18,2)")}

    present = {n: t[n].where(~_every(GONE)) for n in ("orders", "order_items", "payments")}
    status = {"order_status": F.when(_every(RESTATED), "created").otherwise(F.col("order_status"))}
    return {"orders": (earlier(t["orders"], status), present["orders"], ["order_id"]),
            "order_items": (earlier(t["order_items"], dearer("price")), present["order_items"], ["order_id", "order_item_id"]),
            "payments": (earlier(t["payments"], dearer("payment_value")), present["payments"], ["order_id", "payment_sequential"])}


@query("load_changes")
def load_changes(t) -> DataFrame:
    """What differs between two loads of three raw tables: keys added, removed and changed, and rows with their multiplicity."""
    out = None
    for name, (old, new, key) in loads(t).items():
        c = multisets.changes(old, new, key).groupBy("change").agg(
            F.count(F.lit(1)).alias("keys"), F.sum("rows_removed").alias("rows_removed"), F.sum("rows_added").alias("rows_added"))
        c = c.select(F.lit(name).alias("table_name"), "*")
        out = c if out is None else out.unionByName(c)
    return out


@query("load_difference_rows")
def load_difference_rows(t) -> DataFrame:
    """Rows of the earlier order load that the present one lacks (EXCEPT ALL), and rows of both (INTERSECT), per status."""
    old, new, _ = loads(t)["orders"]
    lost = multisets.subtract(old, new, every=True).groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))
    kept = multisets.intersect(old, new).groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))
    return lost.select(F.lit("lost").alias("part"), "*").unionByName(kept.select(F.lit("kept").alias("part"), "*"))


# --------------------------------------------------------------- lateral --

@query("seller_slowest_orders")
def seller_slowest_orders(t) -> DataFrame:
    """Each seller's three slowest deliveries next to the median of their route (seller state to customer state)."""
    d = t.item_view.where(F.col("delivery_days").isNotNull())
    # One row for each seller of an order.
    d = d.groupBy("seller_id", "order_id").agg(*[F.first(c).alias(c) for c in ("seller_state", "customer_state", "delivery_days")])
    # Every task keeps three rows a seller before the shuffle, so a seller of a third of all orders is no large group.
    slowest = Window.partitionBy("seller_id").orderBy(F.desc("delivery_days"), "order_id")
    top = d.withColumn("place", F.row_number().over(slowest)).where(F.col("place") <= SLOWEST)
    route = ["seller_state", "customer_state"]
    median = stats.grouped_quantile(d, route, "delivery_days", 0.5, "route_median")
    m = median.withColumnsRenamed({c: f"_{c}" for c in route})
    out = top.join(m, top["seller_state"].eqNullSafe(m["_seller_state"]) & top["customer_state"].eqNullSafe(m["_customer_state"]))
    return out.select("seller_id", "place", "order_id", *route, "delivery_days", "route_median",
                      (F.col("delivery_days") - F.col("route_median")).alias("days_over_median"))


# ------------------------------------------------------------- documents --

def order_documents(items: DataFrame, payments: DataFrame, rows: int = DOCUMENT_ROWS) -> DataFrame:
    """(order_id, part, doc): orders as nested records with arrays of items and payments, ``rows`` of each a part.

    Both tables go into one grouping, so an order is shuffled once; parts keep an order of very many lines out of one record. Line and
    payment numbers start from 1.
    """
    item = F.struct(F.col("order_item_id").alias("no"), "product_id", "seller_id", "price", "freight_value")
    pay = F.struct(F.col("payment_sequential").alias("no"), F.col("payment_type").alias("type"), F.col("payment_installments").alias("installments"),
                   F.col("payment_value").alias("value"))
    kinds = {"i": items.select(item.alias("s")).schema["s"].dataType, "p": payments.select(pay.alias("s")).schema["s"].dataType}

    def part(c: str):
        return F.floor((F.coalesce(F.col(c), F.lit(1)) - 1) / rows).alias("part")

    both = items.select("order_id", part("order_item_id"), item.alias("i"), F.lit(None).cast(kinds["p"]).alias("p")).unionByName(
        payments.select("order_id", part("payment_sequential"), F.lit(None).cast(kinds["i"]).alias("i"), pay.alias("p")))
    grouped = both.groupBy("order_id", "part").agg(F.sort_array(F.collect_list("i")).alias("items"), F.sort_array(F.collect_list("p")).alias("payments"))
    return grouped.select("order_id", "part", F.struct("order_id", "part", "items", "payments").alias("doc"))


@query("order_document_totals")
def order_document_totals(t) -> DataFrame:
    """Totals worked out inside each order's nested arrays, after the documents went through JSON and back."""
    docs = order_documents(t["order_items"], t["payments"])
    schema = docs.schema["doc"].dataType
    docs = docs.withColumn("back", F.from_json(F.to_json("doc"), schema))
    money = F.lit(0).cast("decimal(28,2)")
    d = F.col("back")

    def total(array, of):
        return F.aggregate(array, money, lambda s, x: (s + F.coalesce(of(x), money)).cast("decimal(28,2)"))

    dear = F.filter(d["items"], lambda x: x["price"] >= 50_000)
    parts = docs.select(
        "order_id", F.size(d["items"]).alias("items"), F.size(d["payments"]).alias("payments"), total(d["items"], lambda x: x["price"]).alias("price"),
        total(d["items"], lambda x: x["freight_value"]).alias("freight"), total(d["payments"], lambda x: x["value"]).alias("paid"),
        F.size(dear).alias("dear_items"), F.array_max(F.transform(d["payments"], lambda x: x["installments"])).alias("most_installments"),
        F.transform(d["payments"], lambda x: x["type"]).alias("types"), d.eqNullSafe(F.col("doc")).alias("same"))
    # The types of a part are as many as there are codes; all others are numbers.
    parts = parts.withColumn("types", F.array_sort(F.array_distinct(F.array_compact("types"))))
    out = parts.groupBy("order_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("items", "payments", "dear_items")], *[F.sum(c).cast("double").alias(c) for c in ("price", "freight", "paid")],
        F.max("most_installments").alias("most_installments"), F.bool_and("same").alias("json_same"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("payment_types"))
    return out


# -------------------------------------------------------------- sketches --

def monthly_sketches(t) -> DataFrame:
    """One row per month: mergeable sketches of its customers (HyperLogLog) and delivery days (KLL quantiles), to be stored."""
    return t.orders_summary.groupBy("order_month").agg(
        F.hll_sketch_agg(F.col("customer_unique_id").cast("string"), LG_K).alias("customers"), F.kll_sketch_agg_double("delivery_days", K).alias("delivery_days"))


def merged_sketches(monthly: DataFrame, period) -> DataFrame:
    """Estimates for any period from the months' sketches; no order is read again."""
    return monthly.groupBy(period.alias("period")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"), F.kll_merge_agg_double("delivery_days", K).alias("d")).select(
        "period", "customers", F.kll_sketch_get_quantile_double("d", F.lit(0.5)).alias("median_days"),
        F.kll_sketch_get_quantile_double("d", F.lit(0.9)).alias("p90_days"))


@query("sketched_quarters")
def sketched_quarters(t) -> DataFrame:
    """Customers of each quarter, and whether the estimates from monthly sketches are close: customers within 5 %, median and 90 %
    delivery days within 3 % of their ranks."""
    quarter = F.trunc("order_month", "quarter")
    estimates = merged_sketches(monthly_sketches(t), quarter).withColumnRenamed("customers", "estimate")
    orders = t.orders_summary.select(quarter.alias("period"), "customer_unique_id", "delivery_days").join(estimates, "period")
    days, people = F.col("delivery_days"), F.count_distinct("customer_unique_id")
    n = F.count(days).cast("double")

    def close(q: float, value: str):
        room = F.lit(0.03) + F.try_divide(F.lit(1.0), n)
        below, upto = (F.try_divide(F.count_if(c).cast("double"), n) for c in (days < F.col(value), days <= F.col(value)))
        return F.coalesce((below - room <= q) & (F.lit(q) <= upto + room), F.lit(True))  # true where nothing was delivered

    return orders.groupBy("period").agg(
        people.alias("customers"), (F.abs(F.max("estimate") - people) <= F.greatest(F.lit(1.0), people * 0.05)).alias("customers_close"),
        close(0.5, "median_days").alias("median_close"), close(0.9, "p90_days").alias("p90_close"))
