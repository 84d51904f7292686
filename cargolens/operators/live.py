"""Queries over streams (driver tables only: they need the events as files that arrive)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..session import checkpoint_dir
from ..sources import adapter
from ..streaming.order_figures import OrderFigures


def taken_in(t) -> OrderFigures:
    """A fresh store that has taken in all events of the tables' folder."""
    if t.source is None:
        raise ValueError("a stream needs the folder of the driver tables (Tables.source)")
    orders = t.spark.read.parquet(f"{t.source}/orders.parquet")
    store = OrderFigures(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/figures-{uuid.uuid4().hex}", lambda e: adapter.event_facts(e, orders))
    store.take_in(adapter.event_stream(t.spark, f"{t.source}/events.parquet"))
    return store


@query("stream_order_figures")
def stream_order_figures(t) -> DataFrame:
    """Payment and review figures of every order with events, kept by a stream; equal to the batch cleaning's."""
    return taken_in(t).orders()


@query("stream_daily_payments")
def stream_daily_payments(t) -> DataFrame:
    """Orders, events, valid payments and their value per day of event time, kept by a stream."""
    return taken_in(t).windows().withColumn("day", F.col("window_start").cast("date")).drop("window_start")
