"""The table set a query runs against.

``Tables`` holds the nine raw DataFrames and derives the cleaned and modelled
ones on first use (memoised per instance, still lazy: nothing runs until an
action). ``materialize`` writes the derived tables that many queries share
to Parquet in the cluster's shared checkpoint folder and returns a
``Tables`` reading them, which is what the reference's CREATE TABLE AS
steps do; it also cuts the lineage.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, driver_config
from ..operators import clean, model
from ..session import checkpoint_dir, configure
from ..sources import adapter
from ..sources.sinks import write_table


class Tables:
    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], cfg: Config,
                 derived: dict[str, DataFrame] | None = None, source: str | None = None):
        self.spark = spark
        self.source = source  # the folder of the driver tables, for streams over them
        self.raw = raw
        self.cfg = cfg
        for name, df in (derived or {}).items():
            self.__dict__[name] = df  # pre-fills the cached properties
        self._written = set(derived or ())

    def __getitem__(self, name: str) -> DataFrame:
        return self.raw[name]

    # -- cleaning --------------------------------------------------------
    @cached_property
    def translation(self) -> DataFrame:
        return clean.translation_fixed(self.spark, self.raw["category_translation"], self.cfg)

    @cached_property
    def reviews_clean(self) -> DataFrame:
        return clean.reviews_clean(self.raw["reviews"])

    @cached_property
    def products_clean(self) -> DataFrame:
        return clean.products_clean(self.raw["products"], self.translation)

    @cached_property
    def orders_clean(self) -> DataFrame:
        return clean.orders_clean(self.raw["orders"])

    @cached_property
    def payments_clean(self) -> DataFrame:
        return clean.payments_clean(self.raw["payments"])

    @cached_property
    def payments_order_agg(self) -> DataFrame:
        # Payments that still have their own ids need no sequence number per order to tell which came first.
        events = self.raw.get("payment_events")
        return clean.payments_order_agg(self.payments_clean if events is None else
                                        clean.payments_clean(events.withColumnRenamed("payment_id", "payment_sequential")))

    @cached_property
    def geolocation_clean(self) -> DataFrame:
        return clean.geolocation_clean(self.raw["geolocation"])

    # -- model -----------------------------------------------------------
    @cached_property
    def orders_window(self) -> DataFrame:
        return model.in_window(self.orders_clean, self.cfg)

    @cached_property
    def orders_enriched(self) -> DataFrame:
        return model.orders_enriched(self.orders_clean, self.raw["customers"],
                                     self.reviews_clean, self.payments_order_agg, self.cfg)

    @cached_property
    def item_view(self) -> DataFrame:
        return model.item_view(self.raw["order_items"], self.orders_enriched,
                               self.products_clean, self.raw["sellers"])

    @cached_property
    def orders_summary(self) -> DataFrame:
        # Sums and counts do not need the lines numbered.
        return model.orders_summary(self.raw.get("order_lines", self.raw["order_items"]), self.orders_enriched)

    @property
    def delivered(self) -> DataFrame:
        return model.delivered(self.orders_summary)

    @property
    def reviewed(self) -> DataFrame:
        return model.reviewed(self.orders_summary)

    @property
    def reviewed_delivered(self) -> DataFrame:
        return model.reviewed_delivered(self.orders_summary)

    #: Columns of the order summary that only the chain of aggregates over products and sellers gives.
    KINDS = frozenset({"unique_products", "unique_sellers"})

    def measured(self, *columns: str) -> "Tables":
        """These columns of the order summary computed now, once, into spark.checkpoint.dir, for queries that pass over
        them several times (ranks, medians): each pass then reads files instead of running the whole lineage. What the
        other columns take (payments, the numbers of different products and sellers) is neither read nor computed. A
        written summary stays as it is; these tables themselves do not change: other queries on them plan from their sources."""
        if "orders_summary" in self._written:
            return self
        if self.KINDS.isdisjoint(columns):
            items = self.raw.get("order_lines", self.raw["order_items"])
            summary = model.orders_summary(items, self.orders_enriched, model.amounts_by_order)
        else:
            summary = self.orders_summary
        kept = {n: self.__dict__[n] for n in self._written}
        return Tables(self.spark, self.raw, self.cfg, kept | {"orders_summary": self.kept(summary.select(*columns))}, self.source)

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` computed now, once, into spark.checkpoint.dir."""
        checkpoint_dir(self.spark)
        return df.checkpoint(eager=True)

    # -- materialisation ---------------------------------------------------
    STAGE1 = ("orders_clean", "reviews_clean", "products_clean", "payments_order_agg",
              "geolocation_clean")
    STAGE2 = ("orders_enriched",)
    STAGE3 = ("orders_summary", "item_view")

    def materialize(self, path: str | None = None,
                    names: tuple[str, ...] = STAGE1 + STAGE2 + STAGE3,
                    raw_names: tuple[str, ...] = (), parallel: int = 4) -> "Tables":
        """Write the shared derived tables as Parquet and read them back.

        ``path`` defaults to a folder of this run under ``spark.checkpoint.dir`` (a shared
        filesystem on a cluster). Clean tables are written first, the orders with their customers,
        reviews and payments next, and the summary and item view are then both built from those files, so no
        lineage is computed twice, and the view's join reads plain tables on both sides, so that
        adaptive execution can split an order with a large share of the lines. The summary and the view are partitioned by month,
        so month filters prune files. ``raw_names`` also writes raw tables
        that are themselves computed (the driver-table adapter's), so they
        are built once. Independent writes of a stage are submitted from up
        to ``parallel`` threads, so Spark can schedule them side by side when
        one job alone does not fill the cluster.
        """
        from concurrent.futures import ThreadPoolExecutor

        base = path or os.path.join(checkpoint_dir(self.spark), f"model-{uuid.uuid4().hex}")

        def run_stage(jobs: list[tuple[str, DataFrame, tuple, tuple]]) -> None:
            def one(job):
                out, df, part, cluster = job
                write_table(df, out, partition_by=part, cluster_by=cluster)
            with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
                list(pool.map(one, jobs))

        raw = dict(self.raw)
        run_stage([(os.path.join(base, "raw", n), self.raw[n], (), ()) for n in raw_names])
        for n in raw_names:
            raw[n] = self.spark.read.parquet(os.path.join(base, "raw", n))
        derived: dict[str, DataFrame] = {}
        current: Tables = Tables(self.spark, raw, self.cfg, source=self.source)
        for stage in (self.STAGE1, self.STAGE2, self.STAGE3):
            todo = [n for n in stage if n in names]
            part = ("order_month",) if stage is self.STAGE3 else ()
            cluster = ("order_id",) if part else ()
            run_stage([(os.path.join(base, n), getattr(current, n), part, cluster) for n in todo])
            for n in todo:
                derived[n] = self.spark.read.parquet(os.path.join(base, n))
            current = Tables(self.spark, raw, self.cfg, dict(derived), self.source)
        return current


def driver_tables(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> Tables:
    """Tables over the driver parquet at ``sf_dir`` through the adapter."""
    configure(spark)
    return Tables(spark, adapter.raw_tables(spark, sf_dir), cfg or driver_config(), source=sf_dir)
