"""Driver tables -> the nine raw marketplace tables (FIXTURES.md §3).

The test data are TPC-H-shaped (orders, lineitem, customer, supplier, part,
nation, events, embeddings). This module re-shapes them, column by column,
into the raw tables the reference's pipeline expects. Every rule is a plain
Spark expression, so the adapter scales with the tables; the SQL oracle has
the same rules written in DuckDB SQL (``plans/oracle_base.py``).

Keys stay 64-bit integers (``o_orderkey`` is the order id, ``l_partkey`` the
product id, ...). Wherever a rule needs "a number of days", it is derived
from the row's own columns, so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRIVER_TABLES = ("orders", "lineitem", "customer", "supplier", "part", "nation",
                 "events", "embeddings")

# Fixed values of the adapter (ours; the oracle repeats them):
#   status map           F -> delivered, O -> shipped, P -> canceled
#   purchase hour        o_orderkey mod 24
#   approval delay       o_orderkey mod 48 hours; NULL where o_orderkey mod 101 = 0
#   delivery days        (last ship date - order date) mod 45, non-negative
#   carrier hand-off     8 hours per delivery day (a third of the delivery time)
#   missing delivery     o_orderkey mod 997 = 0 (status stays delivered)
#   estimate             24 days after purchase
#   product gaps         p_partkey mod 50 = 0: no category and no listing data;
#                        p_partkey mod 499 = 0: no weight and no dimensions
#   payment types        view -> credit_card, click -> boleto, signup -> voucher,
#                        purchase -> debit_card, error -> not_defined
#   zero payment         event_id mod 97 = 0
#   unanswered review    event_id mod 89 = 0
#   zip prefixes         25 (vec_id mod 25), state = that nation's name
UNTRANSLATED_BRANDS = ("Brand#7", "Brand#19")
STATUS_MAP = (("F", "delivered"), ("O", "shipped"), ("P", "canceled"))
PAYMENT_TYPE_MAP = (("view", "credit_card"), ("click", "boleto"), ("signup", "voucher"),
                    ("purchase", "debit_card"), ("error", "not_defined"))


_SCHEMAS: dict = {}


def _modified(spark: SparkSession, path: str) -> int:
    """Modification time of a file or folder, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime()


def read_driver_tables(spark: SparkSession, sf_dir: str,
                       names: tuple[str, ...] = DRIVER_TABLES) -> dict[str, DataFrame]:
    """The driver parquet files. Timestamps are pinned to timestamp_ntz
    (wall-clock), whatever the session's Parquet inference setting."""
    from pyspark.sql.types import TimestampType

    out = {}
    for n in names:
        path = f"{sf_dir}/{n}.parquet"
        # The footer schema is read once per state of the file and process; later
        # reads pass it explicitly, which skips the schema-inference job.
        key = (path, _modified(spark, path))
        if key not in _SCHEMAS:
            _SCHEMAS[key] = spark.read.parquet(path).schema
        df = spark.read.schema(_SCHEMAS[key]).parquet(path)
        ts = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
        out[n] = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts}) if ts else df
    return out


def _map(c, pairs):
    expr = None
    for k, v in pairs:
        cond = c == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def _add_hours(ts, hours):
    return F.timestamp_add("HOUR", hours, ts)


def _add_days(ts, days):
    return F.timestamp_add("DAY", days, ts)


def orders(d: dict[str, DataFrame]) -> DataFrame:
    # One partial + final aggregate of lineitem on the order key; the result
    # is one row per order, joined 1:1.
    last_ship = (d["lineitem"].groupBy("l_orderkey")
                 .agg(F.max("l_shipdate").alias("last_ship")))
    o = d["orders"].join(last_ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    purchase = _add_hours(F.col("o_orderdate"), F.pmod(k, F.lit(24)))
    days = F.pmod(F.datediff(F.col("last_ship"), F.col("o_orderdate")), F.lit(45))
    status = _map(F.col("o_orderstatus"), STATUS_MAP)
    return o.select(
        k.alias("order_id"),
        k.alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        F.when(F.pmod(k, F.lit(101)) != 0, _add_hours(purchase, F.pmod(k, F.lit(48))))
        .alias("order_approved_at"),
        F.when(F.col("o_orderstatus") != "P", _add_hours(purchase, days * 8))
        .alias("order_delivered_carrier_date"),
        F.when((F.col("o_orderstatus") == "F") & (F.pmod(k, F.lit(997)) != 0),
               _add_days(purchase, days)).alias("order_delivered_customer_date"),
        _add_days(purchase, F.lit(24)).alias("order_estimated_delivery_date"),
    )


LINEITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _line_columns(number) -> list:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return [
        F.col("l_orderkey").alias("order_id"),
        number.cast("int").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,2)").alias("freight_value"),
    ]


def order_items(d: dict[str, DataFrame]) -> DataFrame:
    # (l_orderkey, l_linenumber) is not unique but whole rows are, so the
    # sequence number orders by every column. The window partitions by the
    # order key, which is also the key every later step groups or joins on.
    w = Window.partitionBy("l_orderkey").orderBy(*LINEITEM_ORDER)
    return d["lineitem"].select(*_line_columns(F.row_number().over(w)))


def order_lines(d: dict[str, DataFrame]) -> DataFrame:
    """The items by the source's own line numbers, which repeat: for sums and counts, which need no sequence and so no window."""
    return d["lineitem"].select(*_line_columns(F.col("l_linenumber")))


def customers(d: dict[str, DataFrame]) -> DataFrame:
    # One customer row per order, as in the published data; the person is the
    # TPC-H customer. nation is 25 rows: a broadcast of fixed size.
    c = d["customer"].join(F.broadcast(d["nation"]),
                           F.col("c_nationkey") == F.col("n_nationkey"))
    return d["orders"].join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").cast("int").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def sellers(d: dict[str, DataFrame]) -> DataFrame:
    s = d["supplier"].join(F.broadcast(d["nation"]),
                           F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").cast("int").alias("seller_zip_code_prefix"),
        F.lower("n_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def products(d: dict[str, DataFrame]) -> DataFrame:
    p = d["part"]
    listed = F.pmod(F.col("p_partkey"), F.lit(50)) != 0
    measured = F.pmod(F.col("p_partkey"), F.lit(499)) != 0
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(listed, F.col("p_brand")).alias("product_category_name"),
        F.when(listed, F.length("p_name")).cast("int").alias("product_name_lenght"),
        F.when(listed, size * 40).cast("int").alias("product_description_lenght"),
        F.when(listed, F.pmod(size, F.lit(6))).cast("int").alias("product_photos_qty"),
        F.when(measured, size * 250).cast("int").alias("product_weight_g"),
        F.when(measured, size + 5).cast("int").alias("product_length_cm"),
        F.when(measured, F.pmod(size, F.lit(10)) + 2).cast("int").alias("product_height_cm"),
        F.when(measured, F.pmod(size, F.lit(7)) + 3).cast("int").alias("product_width_cm"),
    )


def category_translation(d: dict[str, DataFrame]) -> DataFrame:
    brands = d["part"].select(F.col("p_brand").alias("product_category_name")).distinct()
    return (brands.where(~F.col("product_category_name").isin(*UNTRANSLATED_BRANDS))
            .withColumn("product_category_name_english", F.lower("product_category_name")))


def _event_order_id(d: dict[str, DataFrame]) -> tuple[DataFrame, object]:
    """Events with the order each one refers to: (e^2 + user) mod #orders.

    The order count is a one-row aggregate, crossed in as a broadcast of one
    row. Arithmetic runs in DECIMAL(38,0) so e^2 cannot overflow at any scale.
    """
    n = d["orders"].agg(F.count(F.lit(1)).alias("n_orders"))
    e = d["events"].crossJoin(F.broadcast(n))
    nn = F.col("n_orders").cast("decimal(38,0)")
    em = F.pmod(F.col("event_id").cast("decimal(38,0)"), nn)
    oid = F.pmod(em * em + F.col("user_id").cast("decimal(38,0)"), nn).cast("long")
    return e, oid


def _review_columns() -> list:
    eid = F.col("event_id")
    return [
        eid.alias("review_id"),
        (F.pmod(eid, F.lit(5)) + 1).cast("int").alias("review_score"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("review_comment_title"),
        F.when(F.col("event_type").isin("click", "error"), F.col("props")).alias("review_comment_message"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("review_creation_date"),
        F.when(F.pmod(eid, F.lit(89)) != 0, F.col("ts")).alias("review_answer_timestamp"),
    ]


def _payment_columns() -> list:
    eid = F.col("event_id")
    return [
        eid.alias("payment_id"),
        _map(F.col("event_type"), PAYMENT_TYPE_MAP).alias("payment_type"),
        (F.pmod(F.col("user_id"), F.lit(12)) + 1).cast("int").alias("payment_installments"),
        F.when(F.pmod(eid, F.lit(97)) == 0, F.lit(0).cast("decimal(18,2)"))
        .otherwise(F.col("value").cast("decimal(18,2)")).alias("payment_value"),
    ]


def reviews(d: dict[str, DataFrame]) -> DataFrame:
    e, oid = _event_order_id(d)
    first, *rest = _review_columns()
    return e.select(first, oid.alias("order_id"), *rest)


def payment_events(d: dict[str, DataFrame]) -> DataFrame:
    """One row per payment with its own id and time, which the published export leaves out."""
    e, oid = _event_order_id(d)
    return e.select(oid.alias("order_id"), "ts", *_payment_columns())


def payments(d: dict[str, DataFrame]) -> DataFrame:
    w = Window.partitionBy("order_id").orderBy("payment_id")
    return payment_events(d).select(
        "order_id",
        F.row_number().over(w).cast("int").alias("payment_sequential"),
        "payment_type", "payment_installments", "payment_value",
    )


def geolocation(d: dict[str, DataFrame]) -> DataFrame:
    g = d["embeddings"].select(
        F.pmod(F.col("vec_id"), F.lit(25)).cast("int").alias("geolocation_zip_code_prefix"),
        (F.lit(-15.0) + F.lit(30.0) * F.element_at("embedding", 1).cast("double"))
        .alias("geolocation_lat"),
        (F.lit(-50.0) + F.lit(30.0) * F.element_at("embedding", 2).cast("double"))
        .alias("geolocation_lng"),
        F.col("label").cast("string").alias("geolocation_city"),
    )
    nation = F.broadcast(d["nation"].select(
        F.col("n_nationkey").cast("int").alias("geolocation_zip_code_prefix"),
        F.col("n_name").alias("geolocation_state")))
    return g.join(nation, "geolocation_zip_code_prefix", "left")


BUILDERS = {
    "orders": orders,
    "order_items": order_items,
    "customers": customers,
    "payments": payments,
    "reviews": reviews,
    "products": products,
    "sellers": sellers,
    "category_translation": category_translation,
    "geolocation": geolocation,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All nine raw tables over the driver parquet at ``sf_dir``, and payments and lines as they are before they are numbered (lazy)."""
    d = read_driver_tables(spark, sf_dir)
    return {name: build(d) for name, build in (BUILDERS | {"payment_events": payment_events, "order_lines": order_lines}).items()}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events file, or a folder that receives such files, as a stream."""
    schema = spark.read.parquet(path).schema
    # A stream's plain path has to be a folder; a pattern may match a single file as well.
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def event_facts(events: DataFrame, orders: DataFrame) -> DataFrame:
    """What each event says about its order, as a payment and as a review: one row per event of a table or a stream."""
    e, oid = _event_order_id({"events": events, "orders": orders})
    return e.select("event_id", "ts", oid.alias("order_id"), *_payment_columns(), *_review_columns())
