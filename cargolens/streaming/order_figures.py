"""Per-order payment and review figures, kept from a stream of events.

Two streams, each with its own checkpoint, run until nothing is left to read (``availableNow``) and go on from there at the next call:

1. events -> ``clean``: an event that comes again within the watermark is dropped by its id (state: ids, until the watermark passes them);
2. ``clean`` -> ``figures``: one row of additive figures per order and event-time window (state: these rows, until the
   watermark passes their window). Each micro-batch writes the rows that it changed into a folder of its own, so a batch that is run again
   after a failure replaces its own rows and nothing else. Every so many batches the newest rows of all folders are written as a new base.

The order figures are the sum over an order's windows of the newest rows. State is bounded by the watermark, not by the orders; an order with
a third of all events is added up map-side. Events later than the watermark change nothing and are counted (``take_in``). Plain aggregates
throughout, no Python state functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much later than the latest event seen an event may come, and the width of the windows.
LATE, WINDOW = "2 days", "1 day"
#: Batches between two bases.
BASE_EVERY = 16
TIME = "event_time"

FACT_COLUMNS = ("event_id", "ts", "order_id", "payment_id", "payment_type", "payment_installments", "payment_value", "review_id", "review_score",
                "review_comment_message", "review_answer_timestamp")


def additive() -> list:
    """Figures of a group of event facts that add up over groups (see ``merged``)."""
    def valid(c):
        # Like the batch cleaning: only value 0 and type 'not_defined' are anomalies; nulls are not.
        anomaly = F.coalesce(F.col("payment_value") == 0, F.lit(False)) | F.coalesce(F.col("payment_type") == "not_defined", F.lit(False))
        return F.when(~anomaly, c)

    review = F.struct(F.col("review_answer_timestamp").alias("answered"), F.col("review_score").alias("score"), F.col("review_id").alias("id"),
                      F.col("review_comment_message").isNotNull().alias("commented"))
    largest = F.struct(F.col("payment_value").alias("value"), (-F.col("payment_id")).alias("order"), F.col("payment_type").alias("type"),
                       F.col("payment_installments").alias("installments"))
    return [F.count(F.lit(1)).alias("events"), F.count(valid(F.lit(1))).alias("payments"), F.sum(valid(F.col("payment_value"))).alias("value"),
            F.max(valid(F.col("payment_installments"))).alias("installments"), F.max(valid(largest)).alias("largest"),
            F.min(valid(F.col("payment_type"))).alias("first_type"), F.max(valid(F.col("payment_type"))).alias("last_type"),
            F.max(review).alias("review")]


ADDED = {"events": F.sum, "payments": F.sum, "value": F.sum, "installments": F.max, "largest": F.max, "first_type": F.min, "last_type": F.max,
         "review": F.max}


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Additive figures of larger groups; amounts keep their type."""
    out = rows.groupBy(*by).agg(*[f(c).alias(c) for c, f in ADDED.items()])
    return out.select(*by, *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ADDED])


def order_columns(rows: DataFrame) -> DataFrame:
    """The order summary's columns from one row of additive figures per order."""
    some = F.col("payments") > 0
    return rows.select(
        "order_id", F.when(some, F.col("payments")).alias("payment_count"), F.col("largest.type").alias("primary_payment_type"),
        F.col("largest.installments").alias("primary_installments"), F.col("installments").alias("max_installments"),
        F.col("value").cast("double").alias("total_payment_value"),
        F.when(some, F.coalesce(F.col("first_type") != F.col("last_type"), F.lit(False))).alias("is_multi_payment"),
        F.col("review.score").alias("review_score"), F.col("review.commented").alias("has_comment"))


class OrderFigures:
    """The store in ``folder``, which the driver and all executors share: ``clean``, ``figures`` and the checkpoints of both streams.

    ``facts`` turns events (with event_id and ts) into rows of FACT_COLUMNS. Events without an id or a time take no part.
    """

    def __init__(self, spark: SparkSession, folder: str, facts, late: str = LATE, window: str = WINDOW, base_every: int = BASE_EVERY):
        self.spark, self.folder, self.facts = spark, folder.rstrip("/"), facts
        self.late, self.window, self.base_every = late, window, base_every

    def take_in(self, events: DataFrame) -> dict[str, int]:
        """All of the stream ``events`` that has come since the last call. Returns how many events were read, dropped as repeats, and came too late."""
        clean = self._timed(events.where(F.col("event_id").isNotNull() & F.col("ts").isNotNull())).dropDuplicatesWithinWatermark(["event_id"])
        first = (clean.drop(TIME).writeStream.format("parquet").option("path", f"{self.folder}/clean").option("checkpointLocation", f"{self.folder}/clean-state")
                 .outputMode("append").trigger(availableNow=True).start())
        first.awaitTermination()
        told = {"read": 0, "repeated": 0, "late": 0}
        for p in first.recentProgress:
            told["read"] += p.numInputRows
            for s in p.stateOperators:
                told["late"] += s.numRowsDroppedByWatermark
                told["repeated"] += s.customMetrics.get("numDroppedDuplicateRows", 0)
        written = self.spark.readStream.schema(events.schema).parquet(f"{self.folder}/clean")
        rows = self._timed(self.facts(written).select(*FACT_COLUMNS))
        partial = rows.groupBy("order_id", F.window(TIME, self.window).alias("w")).agg(*additive())
        partial = partial.select("order_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), *ADDED)
        second = (partial.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.folder}/figures-state")
                  .outputMode("update").trigger(availableNow=True).start())
        second.awaitTermination()
        return told

    def _timed(self, events: DataFrame) -> DataFrame:
        """Event time as a column that a watermark can stand on (wall-clock times do not qualify)."""
        return events.withColumn(TIME, F.col("ts").cast("timestamp")).withWatermark(TIME, self.late)

    # -- the figures' folders: delta-<batch> and base-<batch>, the base holding the newest rows up to and with its batch --------------
    def _write(self, changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.folder}/figures/delta-{batch:012d}")
        if (batch + 1) % self.base_every == 0:
            self._newest(changed.sparkSession, batch).write.mode("overwrite").parquet(f"{self.folder}/figures/base-{batch:012d}")

    def _finished(self, spark: SparkSession) -> list[str]:
        """Names of the folders whose writing has ended."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/figures")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(made(path, f"{n}/_SUCCESS")))

    def _newest(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The newest row of every order and window: the last base (before ``upto``) and the deltas after it."""
        number = {n: int(n.rpartition("-")[2]) for n in self._finished(spark)}
        bases = [n for n in number if n.startswith("base") and (upto is None or number[n] < upto)]
        start = max((number[n] for n in bases), default=-1)
        use = [n for n in number if n in bases and number[n] == start or n.startswith("delta") and number[n] > start and (upto is None or number[n] <= upto)]
        if not use:
            raise ValueError(f"{self.folder} holds no figures yet: call take_in first")
        rows = spark.read.parquet(*[f"{self.folder}/figures/{n}" for n in sorted(use)])
        newest = rows.groupBy("order_id", "window_start").agg(F.max(F.struct("batch", *ADDED)).alias("r"))
        return newest.select("order_id", "window_start", "r.*")

    def orders(self) -> DataFrame:
        """One row per order: the figures of the order summary that events give."""
        return order_columns(merged(self._newest(self.spark), "order_id"))

    def windows(self) -> DataFrame:
        """One row per event-time window: orders with an event, events, valid payments, their value."""
        return self._newest(self.spark).groupBy("window_start").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("events").alias("events"), F.sum("payments").alias("payments"),
            F.sum("value").cast("double").alias("payment_value"))
