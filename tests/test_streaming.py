"""Order figures from a stream: shuffled, late and repeated events, restarts, a batch that is run again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cargolens.operators import clean, live
from cargolens.sources import adapter
from cargolens.streaming.order_figures import OrderFigures

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


def made(n, seed=1):
    """n events over twelve days; user 5 has a third of them."""
    rnd = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=i * 12 * 1440 // n, microseconds=rnd.randrange(10**6)), 5 if i % 3 == 0 else rnd.randrange(20),
             rnd.choice(["view", "click", "signup", "purchase", "error"]), rnd.choice([0.0, 1.25, 8.5, 99.99]), f'{{"k": {i}}}') for i in range(n)]


@pytest.fixture
def orders(spark):
    return spark.range(40).select(F.col("id").alias("o_orderkey"))


def batch(spark, orders, events):
    """The same columns from the batch cleaning."""
    d = {"events": spark.createDataFrame(events, SCHEMA), "orders": orders}
    paid = clean.payments_order_agg(clean.payments_clean(adapter.payments(d)))
    reviews = clean.reviews_clean(adapter.reviews(d)).select("order_id", "review_score", "has_comment")
    return reviews.join(paid, "order_id", "left").select(
        "order_id", "payment_count", "primary_payment_type", "primary_installments", "max_installments",
        F.col("total_payment_value").cast("double").alias("total_payment_value"), "is_multi_payment", "review_score", "has_comment")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


class Feed:
    def __init__(self, spark, folder, orders, **options):
        self.spark, self.folder, self.orders, self.options = spark, folder, orders, options
        (folder / "in").mkdir()
        self.n = 0

    def put(self, events):
        self.n += 1
        self.spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(str(self.folder / "in" / f"f{self.n}"))

    def store(self):
        """A new object each time, as after a restart of the driver."""
        return OrderFigures(self.spark, str(self.folder / "store"), lambda e: adapter.event_facts(e, self.orders), **self.options)

    def take_in(self):
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(self.folder / "in"))
        store = self.store()
        return store, store.take_in(stream)


def test_shuffled_late_and_repeated_events(spark, orders, tmp_path):
    """Three loads in shuffled order with events up to a day late and one in ten sent twice, the driver restarted in between."""
    events = made(900)
    rnd = random.Random(2)
    late = sorted(events, key=lambda e: (e[1] + dt.timedelta(hours=rnd.randrange(24))))
    feed = Feed(spark, tmp_path, orders, base_every=2)
    told = []
    for i in range(3):
        load = late[i * 300:(i + 1) * 300]
        load += load[::10] + (late[(i - 1) * 300 + 250:i * 300:7] if i else [])  # repeats within a load and of the load before
        rnd.shuffle(load)
        feed.put(load)
        store, counts = feed.take_in()
        told.append(counts)
        same(store.orders(), batch(spark, orders, late[:(i + 1) * 300]))
    assert all(c["late"] == 0 for c in told) and sum(c["repeated"] for c in told) == 90 + 16
    assert feed.take_in()[1] == {"read": 0, "repeated": 0, "late": 0}
    same(feed.store().orders(), batch(spark, orders, events))
    days = {r.window_start: r.events for r in feed.store().windows().collect()}
    assert sum(days.values()) == 900 and days[T0] == sum(e[1] < T0 + dt.timedelta(days=1) for e in events)


def test_batches_that_run_again_change_nothing(spark, orders, tmp_path):
    events = made(300)
    feed = Feed(spark, tmp_path, orders, base_every=2)
    for i in range(3):
        feed.put(events[i * 100:(i + 1) * 100])
        store, _ = feed.take_in()
    before = sorted(map(tuple, store.orders().collect()))
    names = store._finished(spark)
    assert any(n.startswith("base") for n in names)
    last = max(n for n in names if n.startswith("delta"))
    again = spark.read.parquet(f"{store.folder}/figures/{last}").drop("batch")
    store._write(spark.createDataFrame(again.collect(), again.schema), int(last.rpartition("-")[2]))
    assert sorted(map(tuple, store.orders().collect())) == before
    # A folder whose writing has not ended does not count.
    (tmp_path / "store" / "figures" / "delta-000000000999").mkdir()
    assert sorted(map(tuple, store.orders().collect())) == before


def test_state_ends_and_later_events_are_counted(spark, orders, tmp_path):
    """What comes after the watermark has passed changes nothing and is told; state does not grow with all events."""
    events = made(600)
    feed = Feed(spark, tmp_path, orders, late="6 hours")
    feed.put(events[:300])
    feed.take_in()
    feed.put(events[300:])
    store, _ = feed.take_in()
    feed.put([(10_000, T0, 1, "view", 5.0, "x"), (10_001, None, 1, "view", 5.0, "x"), (None, events[-1][1], 1, "view", 5.0, "x")])
    store, told = feed.take_in()
    assert told == {"read": 3, "repeated": 0, "late": 1}
    same(store.orders(), batch(spark, orders, events))


def test_a_store_without_figures(spark, orders, tmp_path):
    with pytest.raises(ValueError):
        OrderFigures(spark, str(tmp_path / "x"), lambda e: e).orders()


def test_stream_needs_a_folder(spark, tables):
    from cargolens.plans.tables import Tables
    with pytest.raises(ValueError):
        live.taken_in(Tables(spark, tables.raw, tables.cfg))
