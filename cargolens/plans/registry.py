"""Everything registered, over the driver tables.

``queries()`` maps a name to ``(spark, sf_dir) -> DataFrame``; each call
builds the adapter, cleaning, model and query lazily from the parquet files
in ``sf_dir``. ``oracle_sql()`` maps the same names to DuckDB SQL over the
driver tables, for the queries that SQL can express.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import catalog
from ..config import Config, driver_config
from .oracle_base import with_ctes
from .tables import Tables, driver_tables

QUERY_MODULES = ("sales", "product", "delivery", "satisfaction", "profile", "cleaning_checks",
                 "geo", "report", "star", "timeline", "live", "grouping")
ORACLE_MODULES = ("oracle_sales", "oracle_product", "oracle_delivery", "oracle_satisfaction",
                  "oracle_profile", "oracle_cleaning", "oracle_geo", "oracle_report",
                  "oracle_timeline", "oracle_grouping")


def load_all() -> None:
    for m in QUERY_MODULES:
        importlib.import_module(f"cargolens.operators.{m}")
    for m in ORACLE_MODULES:
        importlib.import_module(f"cargolens.plans.{m}")


def run(name: str, t: Tables) -> DataFrame:
    load_all()
    return catalog.QUERIES[name](t)


def queries(cfg: Config | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn):
        return lambda spark, sf_dir: fn(driver_tables(spark, sf_dir, cfg))

    return {name: bind(fn) for name, fn in catalog.QUERIES.items()}


def oracle_sql(cfg: Config | None = None) -> dict[str, str]:
    load_all()
    cfg = cfg or driver_config()
    return {name: with_ctes(build(cfg), cfg) for name, build in catalog.ORACLES.items()
            if name in catalog.QUERIES}
