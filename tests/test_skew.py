"""A key holding a third of all rows: results stay whole and the heavy
aggregations combine map-side before the shuffle."""

import contextlib
import datetime as dt
import io
from decimal import Decimal

from pyspark.sql import functions as F

from cargolens.operators import clean, model
from cargolens.sources.schemas import LONG_KEYS


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_hot_order_reviews_and_items(spark):
    n = 3000
    hot = 7
    ids = spark.range(n).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") + 1000).alias("order_id"),
        (F.col("id") % 5 + 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.lit(None).cast("timestamp_ntz").alias("review_creation_date"),
        (F.lit(dt.datetime(2018, 1, 1)).cast("timestamp_ntz")
         + F.make_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("review_answer_timestamp"),
    )
    assert [f.name for f in ids.schema.fields] == [f.name for f in LONG_KEYS["reviews"].fields]
    rc = clean.reviews_clean(ids)
    # every order kept once; the hot order keeps its latest review
    assert rc.count() == 1 + (n - n // 3)
    latest = max(i for i in range(n) if i % 3 == 0)
    assert rc.where(F.col("order_id") == hot).first()["review_id"] == latest
    p = plan(rc)
    assert "partial_max" in p              # combined map-side, before the exchange

    items = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") + 1000).alias("order_id"),
        F.col("id").cast("int").alias("order_item_id"),
        (F.col("id") % 50).alias("product_id"), (F.col("id") % 7).alias("seller_id"),
        F.lit(Decimal("2.50")).cast("decimal(18,2)").alias("price"),
        F.lit(Decimal("0.50")).cast("decimal(18,2)").alias("freight_value"))
    agg = model.items_by_order(items)
    h = agg.where(F.col("order_id") == hot).first()
    assert h["item_count"] == n // 3 and h["order_revenue"] == Decimal("2.50") * (n // 3)
    assert h["unique_sellers"] == 7 and h["unique_products"] == len({i % 50 for i in range(0, n, 3)})
    assert "partial_count" in plan(agg) or "partial_sum" in plan(agg)


def test_hot_order_is_split_in_the_item_join(spark, tmp_path):
    """A third of all lines on one order: the view's join against written orders splits that order's partition."""
    n = 60_000
    items = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 1000).alias("order_id"),
                                  F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    items.repartition(12).write.parquet(str(tmp_path / "items"))
    items.select("order_id").distinct().withColumn("status", F.lit("x")).write.parquet(str(tmp_path / "orders"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = spark.read.parquet(str(tmp_path / "items")).join(spark.read.parquet(str(tmp_path / "orders")), "order_id")
        joined.write.mode("overwrite").parquet(str(tmp_path / "out"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        out = spark.read.parquet(str(tmp_path / "out"))  # a file for each task
        assert out.count() == n
        assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < n // 3
    finally:
        for k in conf:
            spark.conf.unset(k)
