"""Readers, sinks and the driver entry point."""

import os

from pyspark.sql.types import LongType

from cargolens.sources import readers
from cargolens.sources.sinks import create_view, insert_if_absent, write_csv, write_table


def test_csv_round_trip_with_explicit_schema(spark, tables, tmp_path):
    out = {}
    for name in ("orders", "order_items", "reviews"):
        path = str(tmp_path / name)
        df = tables[name]
        df.write.mode("overwrite").option("header", True) \
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
        out[name] = path
    back = readers.csv_tables(spark, out, key_type=LongType())
    for name in out:
        assert back[name].count() == tables[name].count()
        assert back[name].schema.names == tables[name].schema.names
    # timestamps survive the trip (second precision in the file)
    a = tables["orders"].agg({"order_purchase_timestamp": "max"}).first()[0]
    b = back["orders"].agg({"order_purchase_timestamp": "max"}).first()[0]
    assert a.replace(microsecond=0) == b


def test_bad_timestamps_become_null_and_are_counted(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                 "order_delivered_carrier_date,order_delivered_customer_date,"
                 "order_estimated_delivery_date\n"
                 "a,b,delivered,2017-01-05 10:00:00,not a date,,,2017-01-20 00:00:00\n")
    from cargolens.sources.schemas import raw_schemas
    df = readers.read_csv_table(spark, str(p), raw_schemas()["orders"])
    r = df.first()
    assert r["order_approved_at"] is None and r["order_purchase_timestamp"].day == 5
    text = spark.read.option("header", True).csv(str(p))
    bad = readers.unparsed_timestamps(text, df, ["order_approved_at"]).first()
    assert bad["order_approved_at"] == 1


def test_insert_if_absent_and_view(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 9), ("z", 3)], "k string, v int")
    out = {r["k"]: r["v"] for r in insert_if_absent(a, b, ["k"]).collect()}
    assert out == {"x": 1, "y": 2, "z": 3}
    create_view(a, "cargolens_test_view")
    assert spark.sql("select count(*) from cargolens_test_view").first()[0] == 2


def test_writers(spark, tables, tmp_path):
    p = write_table(tables.orders_summary, str(tmp_path / "s"), partition_by=("order_month",))
    assert spark.read.parquet(p).count() == tables.orders_summary.count()
    c = write_csv(tables.orders_summary.select("order_id"), str(tmp_path / "c"))
    assert len([f for f in os.listdir(c) if f.endswith(".csv")]) == 1


def test_processed_tables_and_star_schema(spark, tables, tmp_path):
    from cargolens.operators.report import write_processed_tables
    from cargolens.operators.star import build_star_schema
    out = write_processed_tables(tables, str(tmp_path / "processed"))
    assert set(out) == {"kpi_summary", "monthly_trends", "category_performance",
                        "delivery_by_state", "delay_vs_reviews"}
    kpi = spark.read.option("header", True).csv(out["kpi_summary"])
    assert kpi.count() == 10
    star = build_star_schema(tables, str(tmp_path / "star"))
    assert spark.read.parquet(star["fact_order_economics"]).count() == tables.item_view.count()


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert "total_revenue" in df.columns


def test_parquet_catalog_and_csv_folder_readers(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    from cargolens.session import size_for_input
    from cargolens.sources.schemas import RAW_TABLES
    from cargolens.sources.sinks import save_as_table
    base = tmp_path / "raw"
    for name in RAW_TABLES:
        tables[name].write.parquet(str(base / name))
        tables[name].write.option("header", True) \
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(str(tmp_path / "csv" / f"{name}.csv"))
    pq = readers.parquet_tables(spark, str(base))
    assert {n: pq[n].count() for n in RAW_TABLES} == {n: tables[n].count() for n in RAW_TABLES}
    cs = readers.csv_folder(spark, str(tmp_path / "csv"), key_type=LongType())
    assert cs["payments"].count() == tables["payments"].count()
    assert cs["payments"].agg(F.sum("payment_value")).first()[0] == \
        tables["payments"].agg(F.sum("payment_value")).first()[0]
    save_as_table(tables["sellers"], "cargolens_sellers_t", path=str(tmp_path / "tbl"))
    assert spark.table("cargolens_sellers_t").count() == tables["sellers"].count()
    for name in RAW_TABLES:
        tables[name].createOrReplaceGlobalTempView(name)
    cat = readers.catalog_tables(spark, "global_temp")
    assert cat["orders"].count() == tables["orders"].count()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_for_input(spark, 100 * 2**40) == 409_600       # 100 TiB / 256 MiB
        assert size_for_input(spark, 10 * 2**30) == 40              # 10 GiB / 256 MiB
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_csv_with_quoted_newlines_and_doubled_quotes(spark, tmp_path):
    from cargolens.sources.schemas import raw_schemas
    schema = raw_schemas(LongType())["reviews"]
    # header in another order; a comma, a newline and doubled quotes inside fields
    (tmp_path / "r.csv").write_text(
        'order_id,review_id,review_score,review_comment_message,review_comment_title,review_creation_date,review_answer_timestamp\n'
        '11,1,5,"good, ""very"" good","top ""1""",2018-01-01 00:00:00,2018-01-02 10:00:00\n'
        '12,2,1,"first line\nsecond line",,2018-01-01 00:00:00,2018-01-03 11:30:00\n'
        '13,3,x4,plain,,2018-01-01 00:00:00,not a time\n'
        '14,4,3,too,many,2018-01-01 00:00:00,2018-01-04 00:00:00,fields\n', encoding="utf-8")
    got = {r["review_id"]: r for r in readers.read_csv_table(spark, str(tmp_path / "r.csv"), schema).collect()}
    assert len(got) == 4 and [f for f in got[1].asDict()] == [f.name for f in schema.fields]
    assert got[1]["review_comment_message"] == 'good, "very" good' and got[1]["review_comment_title"] == 'top "1"'
    assert got[1]["order_id"] == 11 and str(got[1]["review_answer_timestamp"]) == "2018-01-02 10:00:00"
    assert got[2]["review_comment_message"] == "first line\nsecond line" and got[2]["review_score"] == 1
    assert got[3]["review_score"] is None and got[3]["review_answer_timestamp"] is None
    bad = readers.corrupt_records(spark, str(tmp_path / "r.csv"), schema).first()
    assert (bad["records"], bad["malformed"], bad["mistyped"]) == (4, 1, 1)


def test_csv_folder_of_files_with_different_headers(spark, tmp_path):
    """Every file is bound by its own header; a compressed one and one with a byte order mark too; empty files and marker files don't count."""
    import gzip

    from cargolens.sources.schemas import LONG_KEYS
    schema = LONG_KEYS["sellers"]
    names = [f.name for f in schema.fields]
    rows = {"a": (1, 11, "x", "SP"), "b": (2, 22, "y", "RJ"), "c": (3, 33, "z", "MG"), "d": (4, 44, "a, b", "ES")}

    def text(order, row, extra=""):
        quoted = ",".join(f'"{row[names.index(c)]}"' if c in names else "?" for c in order)
        return ",".join(order) + extra + "\n" + quoted + "\n"

    folder = tmp_path / "sellers.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(text(names, rows["a"]))
    (folder / "b.csv").write_text(text(names[::-1], rows["b"]))
    (folder / "c.csv").write_text("\ufeff" + text([names[1], "more", names[0], names[3]], rows["c"]), encoding="utf-8")
    (folder / "d.csv.gz").write_bytes(gzip.compress(text(names, rows["d"]).encode()))
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.csv").write_text("")
    for multi_line in (True, False):
        got = sorted(map(tuple, readers.read_csv_table(spark, str(folder), schema, multi_line=multi_line).collect()))
        assert got == [rows["a"], rows["b"], (3, 33, None, "MG"), rows["d"]]
    bad = readers.corrupt_records(spark, str(folder), schema).first()
    assert (bad["records"], bad["malformed"], bad["mistyped"]) == (4, 0, 0)


def test_checkpoint_folder_is_an_error_on_a_cluster():
    import pytest

    from cargolens.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
