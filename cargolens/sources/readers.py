"""Readers for the raw tables: CSV files with headers, Parquet, catalog tables.

Always with an explicit schema; timestamps that fail to parse become NULL
(``try_to_timestamp``) and can be counted, instead of failing the job under
ANSI mode.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from .schemas import RAW_TABLES, raw_schemas


def _as_text(schema: StructType) -> StructType:
    """Same columns, timestamps read as text first."""
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, TimestampNTZType)
                                   else f.dataType, True) for f in schema.fields])


CORRUPT = "_corrupt_record"


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path (a file, a folder or a pattern) by their header. One line of each file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    found = fs.globStatus(Path(path)) or []
    files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(files, key=lambda f: f.getPath().toString()):
        if f.isDirectory() or f.getPath().getName()[0] in "._" or not f.getLen():
            continue
        stream = fs.open(f.getPath())
        try:
            codec = codecs.getCodec(f.getPath())
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            line = (reader.readLine() or "").removeprefix("\ufeff")
        finally:
            stream.close()
        out.setdefault(tuple(next(csv.reader([line]), [])), []).append(f.getPath().toString())
    return out


def _csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns of a CSV as text, by their header names, and the text of records
    whose fields do not match the header. Files with different headers are read apart and put together by name."""
    headers = _headers(spark, path)
    if not headers:
        raise FileNotFoundError(f"no CSV file with a header at {path}")
    parts = []
    for header, files in headers.items():
        text = StructType([StructField(c, StringType(), True) for c in (*header, CORRUPT)])
        parts.append(spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
                     .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(text).csv(files))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def corrupt_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: records of a CSV, those whose number of fields is not the header's, and those
    with a value that is not of its column's type."""
    df = _csv_text(spark, path)
    bad = F.lit(False)
    for f in schema.fields:
        if f.name in df.columns and not isinstance(f.dataType, StringType):
            c = F.col(f"`{f.name}`")
            bad = bad | (c.isNotNull() & c.try_cast(f.dataType).isNull())
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"),
                  F.count_if(bad).alias("mistyped"))


def read_csv_table(spark: SparkSession, path: str, schema: StructType,
                   timestamp_format: str = "yyyy-MM-dd HH:mm:ss", multi_line: bool = True) -> DataFrame:
    """A CSV file or folder with headers, as the published export writes them.

    Quoted fields may hold commas, newlines and doubled quotes (RFC 4180). Columns
    are bound by the header name of their own file, in any order; one that is missing is NULL, others are left out. A
    record that does not parse is kept, with NULLs where it does not fit, and
    counted by :func:`corrupt_records`. Quoted newlines keep a file from being
    split: an export without any can be read with ``multi_line=False``, which
    divides files among tasks; others should be written to Parquet once.
    """
    df = _csv_text(spark, path, multi_line)
    wanted = {f.name: f for f in _as_text(schema).fields}
    df = df.select(*[(F.col(f"`{n}`").try_cast(f.dataType) if n in df.columns else F.lit(None).cast(f.dataType)).alias(n)
                     for n, f in wanted.items()])
    cols = []
    for f in schema.fields:
        if isinstance(f.dataType, TimestampNTZType):
            cols.append(F.try_to_timestamp(F.col(f.name), F.lit(timestamp_format))
                        .cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def csv_tables(spark: SparkSession, files: dict[str, str], key_type=StringType(),
               timestamp_format: str = "yyyy-MM-dd HH:mm:ss", multi_line: bool = True) -> dict[str, DataFrame]:
    """The raw tables from CSV files: ``files`` maps a table name (see
    ``RAW_TABLES``) to a file or folder path."""
    schemas = raw_schemas(key_type)
    return {name: read_csv_table(spark, path, schemas[name], timestamp_format, multi_line)
            for name, path in files.items()}


def csv_folder(spark: SparkSession, folder: str, names: dict[str, str] | None = None,
               **kw) -> dict[str, DataFrame]:
    """Every raw table from ``folder``; ``names`` maps table -> file name
    (default ``<table>.csv``)."""
    names = names or {}
    files = {t: os.path.join(folder, names.get(t, f"{t}.csv")) for t in RAW_TABLES}
    return csv_tables(spark, files, **kw)


def parquet_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw tables stored as ``<folder>/<table>`` Parquet datasets."""
    return {t: spark.read.parquet(os.path.join(folder, t)) for t in RAW_TABLES}


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Raw tables registered in the session catalog (``spark.table``)."""
    prefix = f"{database}." if database else ""
    return {t: spark.table(prefix + t) for t in RAW_TABLES}


def unparsed_timestamps(text: DataFrame, parsed: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: values present as text but NULL after parsing."""
    n = text.select(*[F.col(c).isNotNull().alias(c) for c in cols])
    p = parsed.select(*[F.col(c).isNotNull().alias(c) for c in cols])
    a = n.agg(*[F.count_if(F.col(c)).alias(c) for c in cols])
    b = p.agg(*[F.count_if(F.col(c)).alias(c) for c in cols])
    return a.crossJoin(b.toDF(*[f"{c}_ok" for c in cols])).select(
        *[(F.col(c) - F.col(f"{c}_ok")).alias(c) for c in cols])
