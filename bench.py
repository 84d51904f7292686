"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line. Two phases, as the reference works (CREATE TABLE AS,
then queries):

* ``model_build``: adapter + cleaning + model from the raw parquet, written
  as Parquet (orders summary and item view partitioned by month) into a
  fresh folder under spark.checkpoint.dir;
* each headline query on the materialised model: median of three warm runs,
  forced with the no-op sink (full computation, no collect).

``end_to_end_*`` entries run a query from the raw parquet with no
materialisation, once, after an untimed warm-up query. ``shuffles`` counts
the shuffle exchanges in each query's physical plan.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "monthly_sales", "yoy_growth", "revenue_by_payment_type", "repeat_customer_segments",
    "top_categories", "category_pareto", "size_tier_freight", "delivery_dashboard",
    "delivery_by_state", "delivery_by_seller_state", "route_comparison", "estimate_accuracy_bands",
    "review_by_delivery_outcome", "lowest_rated_categories", "multi_factor_satisfaction",
    "delay_spearman", "mann_whitney_route", "price_distribution", "orphan_checks",
    "freight_by_distance", "executive_kpis", "spearman_drivers", "spearman_matrix",
    "revenue_cube", "seller_slowest_orders", "customer_trailing_revenue", "seller_concurrent_orders", "payment_order_state",
)
END_TO_END = ("monthly_sales", "orders_item_view", "items_per_order_dist")


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffles(df) -> int:
    """Shuffle exchanges in the physical plan (broadcasts not counted)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return sum(1 for line in buf.getvalue().splitlines()
               if "Exchange" in line and "BroadcastExchange" not in line
               and "ReusedExchange" not in line)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from cargolens.catalog import QUERIES
    from cargolens.plans.registry import load_all
    from cargolens.plans.tables import driver_tables
    from cargolens.session import checkpoint_dir, get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    spark.sparkContext.setLogLevel("ERROR")
    # The model goes to the shared folder named by spark.checkpoint.dir (a
    # fresh scratch folder where this local session names none).
    scratch = os.path.join(checkpoint_dir(spark), f"bench-{uuid.uuid4().hex[:8]}")
    load_all()

    times: dict[str, float] = {}
    n_shuffles: dict[str, int] = {}
    force(QUERIES["monthly_sales"](driver_tables(spark, sf_dir)))  # JVM warm-up, untimed
    for name in END_TO_END:
        df = QUERIES[name](driver_tables(spark, sf_dir))
        n_shuffles[f"end_to_end_{name}"] = shuffles(df)
        t0 = time.time()
        force(QUERIES[name](driver_tables(spark, sf_dir)))
        times[f"end_to_end_{name}"] = round(time.time() - t0, 3)

    t0 = time.time()
    t = driver_tables(spark, sf_dir).materialize(os.path.join(scratch, "model"),
                                                 raw_names=("order_items",))
    times["model_build"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        n_shuffles[name] = shuffles(QUERIES[name](t))
        force(QUERIES[name](t))  # warm-up
        runs = []
        for _ in range(3):
            t0 = time.time()
            force(QUERIES[name](t))
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "shuffles": n_shuffles}))
    spark.stop()


if __name__ == "__main__":
    main()
