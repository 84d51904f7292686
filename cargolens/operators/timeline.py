"""Orders, payments and customers in time: as-of and interval joins, successive orders, sessions, trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import sequences

# Fixed values (ours; the oracle repeats them):
#   payment time         12 hours before the purchase plus the event's time within its month
#   order states         created (purchase), approved, shipped (hand-off), delivered; of one instant the later state counts
#   session gap          180 days without an order
#   trailing revenue     90 days
#   an order is open     from its purchase to its delivery, or to the estimate where it has none
SESSION_GAP_DAYS = 180
TRAILING_DAYS = 90
STATES = (("created", "order_purchase_timestamp"), ("approved", "order_approved_at"),
          ("shipped", "order_delivered_carrier_date"), ("delivered", "order_delivered_customer_date"))


def order_states(orders: DataFrame) -> DataFrame:
    """(order_id, state, state_since, place): a row for each state that an order has reached."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("state"), F.col(c).alias("state_since")) for i, (s, c) in enumerate(STATES)])
    return orders.select("order_id", F.explode(each).alias("s")).select("order_id", "s.*").where(F.col("state_since").isNotNull())


def timed_payments(payment_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments with a time near their order's: the events themselves all lie in one month."""
    p = payment_events.join(orders.select("order_id", "order_purchase_timestamp"), "order_id")
    into = F.timestamp_diff("MICROSECOND", F.date_trunc("month", "ts").cast("timestamp_ntz"), F.col("ts"))
    at = F.timestamp_add("MICROSECOND", into - F.lit(12 * 3_600_000_000), F.col("order_purchase_timestamp"))
    return p.select("payment_id", "order_id", "payment_value", at.alias("paid_at"))


@query("payment_order_state")
def payment_order_state(t) -> DataFrame:
    """Each payment with the state its order was in at that moment, and since when."""
    paid = timed_payments(t["payment_events"], t["orders"])
    out = sequences.asof_join(paid, order_states(t["orders"]), ["order_id"], "paid_at", ["state", "state_since"], right_time="state_since", tie=["place"])
    return out.withColumn("payment_value", F.col("payment_value").cast("double"))


def customer_orders(t) -> DataFrame:
    """Every order with its person."""
    c = t["customers"].select("customer_id", "customer_unique_id")
    return t["orders"].select("order_id", "customer_id", F.col("order_purchase_timestamp").alias("purchased_at")).join(c, "customer_id").drop("customer_id")


def days(start, end):
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(86_400_000_000.0)


@query("customer_order_gaps")
def customer_order_gaps(t) -> DataFrame:
    """Days from a customer's previous order and to the next one."""
    by, order, columns = ["customer_unique_id"], ["purchased_at", "order_id"], ["purchased_at", "order_id"]
    o = customer_orders(t)
    slices = sequences.Slices([(o, "purchased_at")], by)
    o = sequences.neighbour(o, by, order, columns, "before", slices=slices)
    o = sequences.neighbour(o, by, order, columns, "after", ahead=True, slices=slices)
    return o.select("customer_unique_id", "order_id", F.col("before.order_id").alias("previous_order_id"),
                    days(F.col("before.purchased_at"), F.col("purchased_at")).alias("days_since_previous"),
                    days(F.col("purchased_at"), F.col("after.purchased_at")).alias("days_to_next"))


def order_revenue(t) -> DataFrame:
    return t["order_items"].groupBy("order_id").agg(F.sum("price").alias("revenue"))


@query("customer_sessions")
def customer_sessions(t) -> DataFrame:
    """Runs of orders of a customer that follow within half a year: span, orders, revenue."""
    by = ["customer_unique_id"]
    o = customer_orders(t).join(order_revenue(t), "order_id", "left")
    s = sequences.sessions(o, by, ["purchased_at", "order_id"], SESSION_GAP_DAYS)
    return s.groupBy("customer_unique_id", "session_no").agg(
        F.min("purchased_at").alias("first_order_at"), F.max("purchased_at").alias("last_order_at"),
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").cast("double").alias("revenue"))


@query("customer_trailing_revenue")
def customer_trailing_revenue(t) -> DataFrame:
    """Each order with what its customer has spent in the 90 days up to it."""
    o = customer_orders(t).join(order_revenue(t), "order_id", "left")
    out = sequences.trailing_total(o, ["customer_unique_id"], "purchased_at", F.col("revenue"), TRAILING_DAYS, "trailing_revenue")
    return out.select("customer_unique_id", "order_id", F.col("trailing_revenue").cast("double").alias("trailing_revenue"))


def seller_orders(t, *more: str) -> DataFrame:
    """One row for each seller (and further columns of the items) of an order, whatever the number of its lines, with the time it was open."""
    till = F.coalesce("order_delivered_customer_date", "order_estimated_delivery_date")
    spans = t["orders"].select("order_id", F.col("order_purchase_timestamp").alias("opened"), till.alias("closed"))
    return t["order_items"].select("seller_id", *more, "order_id").distinct().join(spans, "order_id").select("seller_id", *more, "order_id", "opened", "closed")


@query("seller_concurrent_orders")
def seller_concurrent_orders(t) -> DataFrame:
    """Per seller: orders, pairs of them that were open at the same time, orders that were not alone, most others of one order."""
    # Two passes go over these rows: the count of each seller's, and the sequence of starts and ends.
    o = sequences.overlap_counts(t.kept(seller_orders(t)), ["seller_id"], "opened", "closed", "others")
    return o.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("orders"), F.expr("sum(others) div 2").cast("long").alias("overlapping_pairs"),
        F.count_if(F.col("others") > 0).alias("orders_overlapped"), F.max("others").alias("most_others"))


@query("product_orders_at_once")
def product_orders_at_once(t) -> DataFrame:
    """Pairs of orders that waited for the same product of the same seller at the same time, with the first and last such instant."""
    o = seller_orders(t, "product_id")
    span = ("opened", "closed")
    met = sequences.interval_join(o, o, ["seller_id", "product_id"], span, span).where("l.order_id < r.order_id")
    return met.select("seller_id", "product_id", F.col("l.order_id").alias("order_id"), F.col("r.order_id").alias("other_order_id"),
                      F.greatest("l.opened", "r.opened").alias("both_from"), F.least("l.closed", "r.closed").alias("both_to"))
