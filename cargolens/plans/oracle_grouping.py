"""Oracle SQL (DuckDB) for subtotals, changes between loads, lateral picks and documents."""

from __future__ import annotations

from ..catalog import oracle
from ..operators.grouping import GONE, NEW, REPRICED, RESTATED, SLOWEST, TWICE


def _subtotals(source: str, dims: list[str], kind: str, count: str, amount: str) -> str:
    names = ", ".join(dims)
    return f"""
    SELECT {names}, GROUPING_ID({names})::INTEGER AS level, COUNT(*) AS {count}, SUM({amount})::DOUBLE AS revenue,
           COUNT(DISTINCT customer_unique_id) AS customers
    FROM {source} GROUP BY {kind} ({names})"""


@oracle("revenue_cube")
def revenue_cube(cfg):
    return _subtotals("vw_orders_analysis", ["order_month", "customer_state", "product_category_english"], "CUBE", "items", "price")


@oracle("revenue_rollup")
def revenue_rollup(cfg):
    return _subtotals("orders_summary", ["order_year", "order_quarter", "order_month"], "ROLLUP", "orders", "order_revenue")


def _loads(table: str, change: str) -> tuple[str, str]:
    """The earlier and the present load of a raw table."""
    old = f"SELECT * REPLACE ({change}) FROM {table} WHERE order_id % {NEW} <> 0"
    return (f"({old} UNION ALL {old} AND order_id % {TWICE} = 0)", f"(SELECT * FROM {table} WHERE order_id % {GONE} <> 0)")


STATUS = f"CASE WHEN order_id % {RESTATED} = 0 THEN 'created' ELSE order_status END AS order_status"


def _dearer(c: str) -> str:
    return f"CASE WHEN order_id % {REPRICED} = 0 THEN {c} + 1 ELSE {c} END::DECIMAL(18,2) AS {c}"


@oracle("load_changes")
def load_changes(cfg):
    parts = []
    for table, key, change in (("orders", "order_id", STATUS), ("order_items", "order_id, order_item_id", _dearer("price")),
                               ("payments", "order_id, payment_sequential", _dearer("payment_value"))):
        old, new = _loads(f"r_{table}", change)
        parts.append(f"""
        SELECT '{table}' AS table_name, change, COUNT(*) AS keys, SUM(removed)::BIGINT AS rows_removed, SUM(added)::BIGINT AS rows_added
        FROM (SELECT {key}, SUM(removed) AS removed, SUM(added) AS added FROM (
                  SELECT {key}, 1 AS removed, 0 AS added FROM (SELECT * FROM {old} EXCEPT ALL SELECT * FROM {new})
                  UNION ALL SELECT {key}, 0, 1 FROM (SELECT * FROM {new} EXCEPT ALL SELECT * FROM {old})) GROUP BY {key})
             JOIN (SELECT {key}, CASE WHEN NOT bool_or(o) THEN 'added' WHEN bool_or(o) AND bool_or(n) THEN 'changed' ELSE 'removed' END AS change
                   FROM (SELECT {key}, TRUE AS o, FALSE AS n FROM {old} UNION ALL SELECT {key}, FALSE, TRUE FROM {new}) GROUP BY {key})
             USING ({key})
        GROUP BY change""")
    return " UNION ALL ".join(parts)


@oracle("load_difference_rows")
def load_difference_rows(cfg):
    old, new = _loads("r_orders", STATUS)
    return f"""
    SELECT 'lost' AS part, order_status, COUNT(*) AS n FROM (SELECT * FROM {old} EXCEPT ALL SELECT * FROM {new}) GROUP BY order_status
    UNION ALL
    SELECT 'kept', order_status, COUNT(*) FROM (SELECT * FROM {old} INTERSECT SELECT * FROM {new}) GROUP BY order_status"""


@oracle("seller_slowest_orders")
def seller_slowest_orders(cfg):
    return f"""
    WITH d AS (SELECT DISTINCT seller_id, order_id, seller_state, customer_state, delivery_days
               FROM vw_orders_analysis WHERE delivery_days IS NOT NULL)
    SELECT s.seller_id, place::INTEGER AS place, order_id, seller_state, customer_state, delivery_days, route_median,
           delivery_days - route_median AS days_over_median
    FROM (SELECT DISTINCT seller_id FROM d) s,
         LATERAL (SELECT *, row_number() OVER (ORDER BY delivery_days DESC, order_id) AS place FROM d
                  WHERE d.seller_id = s.seller_id ORDER BY place LIMIT {SLOWEST}) t
    JOIN (SELECT seller_state, customer_state, quantile_cont(delivery_days, 0.5) AS route_median FROM d GROUP BY 1, 2) m
         USING (seller_state, customer_state)"""


@oracle("order_document_totals")
def order_document_totals(cfg):
    return """
    SELECT order_id, ifnull(items, 0) AS items, ifnull(payments, 0) AS payments, ifnull(dear_items, 0) AS dear_items,
           ifnull(price, 0)::DOUBLE AS price, ifnull(freight, 0)::DOUBLE AS freight, ifnull(paid, 0)::DOUBLE AS paid,
           most_installments, TRUE AS json_same, ifnull(types, '') AS payment_types
    FROM (SELECT order_id, COUNT(*) AS items, COUNT(*) FILTER (price >= 50000) AS dear_items, SUM(price) AS price, SUM(freight_value) AS freight
          FROM r_order_items GROUP BY order_id)
         FULL JOIN (SELECT order_id, COUNT(*) AS payments, SUM(payment_value) AS paid, max(payment_installments) AS most_installments,
                           string_agg(DISTINCT payment_type, ',' ORDER BY payment_type) AS types
                    FROM r_payments GROUP BY order_id) USING (order_id)"""


@oracle("sketched_quarters")
def sketched_quarters(cfg):
    return """
    SELECT date_trunc('quarter', order_month)::DATE AS period, COUNT(DISTINCT customer_unique_id) AS customers,
           TRUE AS customers_close, TRUE AS median_close, TRUE AS p90_close
    FROM orders_summary GROUP BY 1"""
