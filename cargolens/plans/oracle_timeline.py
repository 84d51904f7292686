"""Oracle SQL (DuckDB) for streams and for orders in time."""

from __future__ import annotations

from ..catalog import oracle
from ..operators.timeline import SESSION_GAP_DAYS, STATES, TRAILING_DAYS

ORDERS_OF = """(SELECT order_id, customer_unique_id, order_purchase_timestamp AS bought
                FROM r_orders JOIN r_customers USING (customer_id))"""
REVENUE = "(SELECT order_id, SUM(price) AS revenue FROM r_order_items GROUP BY order_id)"


def _gap(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b})::DOUBLE / 86400000000.0::DOUBLE)"


@oracle("stream_order_figures")
def stream_order_figures(cfg):
    return """
    SELECT order_id, payment_count, primary_payment_type, primary_installments, max_installments,
           total_payment_value::DOUBLE AS total_payment_value, is_multi_payment, review_score, has_comment
    FROM reviews_clean LEFT JOIN payments_order_agg USING (order_id)"""


@oracle("stream_daily_payments")
def stream_daily_payments(cfg):
    return """
    SELECT ts::DATE AS day, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS events,
           COUNT(*) FILTER (valid) AS payments, (SUM(amount) FILTER (valid))::DOUBLE AS payment_value
    FROM (SELECT ts, order_id, event_type <> 'error' AND event_id % 97 <> 0 AND value::DECIMAL(18,2) <> 0 AS valid,
                 value::DECIMAL(18,2) AS amount FROM r_events)
    GROUP BY 1"""


@oracle("payment_order_state")
def payment_order_state(cfg):
    states = " UNION ALL ".join(f"SELECT order_id, {i} AS place, '{s}' AS state, {c} AS since FROM r_orders WHERE {c} IS NOT NULL"
                                for i, (s, c) in enumerate(STATES))
    return f"""
    WITH states AS (
        SELECT order_id, since, arg_max(state, place) AS state FROM ({states}) GROUP BY order_id, since),
    paid AS (
        SELECT event_id AS payment_id, order_id,
               CASE WHEN event_id % 97 = 0 THEN 0 ELSE value::DECIMAL(18,2)::DOUBLE END AS payment_value,
               order_purchase_timestamp - INTERVAL 12 HOUR + (ts - date_trunc('month', ts)) AS paid_at
        FROM r_events JOIN r_orders USING (order_id))
    SELECT payment_id, paid.order_id, payment_value, paid_at, state, since AS state_since
    FROM paid ASOF LEFT JOIN states ON paid.order_id = states.order_id AND paid.paid_at >= states.since"""


@oracle("customer_order_gaps")
def customer_order_gaps(cfg):
    return f"""
    SELECT customer_unique_id, order_id, lag(order_id) OVER w AS previous_order_id,
           {_gap('lag(bought) OVER w', 'bought')} AS days_since_previous, {_gap('bought', 'lead(bought) OVER w')} AS days_to_next
    FROM {ORDERS_OF}
    WINDOW w AS (PARTITION BY customer_unique_id ORDER BY bought, order_id)"""


@oracle("customer_sessions")
def customer_sessions(cfg):
    return f"""
    WITH marked AS (
        SELECT *, ifnull(bought - lag(bought) OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id)
                         > INTERVAL {SESSION_GAP_DAYS} DAY, TRUE)::INTEGER AS starts
        FROM {ORDERS_OF} LEFT JOIN {REVENUE} USING (order_id)),
    numbered AS (
        SELECT *, SUM(starts) OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no
        FROM marked)
    SELECT customer_unique_id, session_no, min(bought) AS first_order_at, max(bought) AS last_order_at, COUNT(*) AS orders,
           SUM(revenue)::DOUBLE AS revenue
    FROM numbered GROUP BY 1, 2"""


@oracle("customer_trailing_revenue")
def customer_trailing_revenue(cfg):
    return f"""
    SELECT customer_unique_id, order_id,
           (SUM(revenue) OVER (PARTITION BY customer_unique_id ORDER BY bought
                               RANGE BETWEEN INTERVAL {TRAILING_DAYS} DAY PRECEDING AND CURRENT ROW))::DOUBLE AS trailing_revenue
    FROM {ORDERS_OF} LEFT JOIN {REVENUE} USING (order_id)"""


@oracle("seller_concurrent_orders")
def seller_concurrent_orders(cfg):
    return """
    WITH spans AS (
        SELECT DISTINCT seller_id, order_id, order_purchase_timestamp AS opened,
               ifnull(order_delivered_customer_date, order_estimated_delivery_date) AS closed
        FROM r_order_items JOIN r_orders USING (order_id)),
    others AS (
        SELECT a.seller_id, a.order_id, COUNT(b.order_id) AS n
        FROM spans a LEFT JOIN spans b
          ON a.seller_id = b.seller_id AND a.order_id <> b.order_id AND a.opened < b.closed AND b.opened < a.closed
         AND a.opened < a.closed AND b.opened < b.closed
        GROUP BY 1, 2)
    SELECT seller_id, COUNT(*) AS orders, (SUM(n) / 2)::BIGINT AS overlapping_pairs,
           COUNT(*) FILTER (n > 0) AS orders_overlapped, max(n) AS most_others
    FROM others GROUP BY seller_id"""


@oracle("product_orders_at_once")
def product_orders_at_once(cfg):
    return """
    WITH spans AS (
        SELECT DISTINCT seller_id, product_id, order_id, order_purchase_timestamp AS opened,
               ifnull(order_delivered_customer_date, order_estimated_delivery_date) AS closed
        FROM r_order_items JOIN r_orders USING (order_id))
    SELECT a.seller_id, a.product_id, a.order_id, b.order_id AS other_order_id,
           greatest(a.opened, b.opened) AS both_from, least(a.closed, b.closed) AS both_to
    FROM spans a JOIN spans b ON a.seller_id = b.seller_id AND a.product_id = b.product_id AND a.order_id < b.order_id
     AND a.opened < b.closed AND b.opened < a.closed AND a.opened < a.closed AND b.opened < b.closed"""
