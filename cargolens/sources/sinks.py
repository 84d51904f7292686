"""Sinks and table-maintenance helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def insert_if_absent(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO NOTHING, as a new DataFrame.

    Parquet has no upsert; an anti-join keeps only the new keys, then a
    union appends them. ``rows`` is expected to be the small side.
    """
    new = rows.join(target.select(*key), list(key), "left_anti")
    return target.unionByName(new)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite", cluster_by: Sequence[str] = ()) -> str:
    """DROP TABLE + CREATE TABLE AS: rewrite ``path`` as Parquet.

    With ``partition_by``, rows are first range-partitioned by the partition
    columns and then ``cluster_by``: each task holds a contiguous slice of
    partition values, so it writes one or two directories instead of one
    file per (task, partition value), and the extra key lets the range
    bounds split a partition value that holds a large share of the rows.
    """
    if partition_by:
        df = df.repartitionByRange(*partition_by, *cluster_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def save_as_table(df: DataFrame, name: str, partition_by: Sequence[str] = (),
                  path: str | None = None) -> None:
    """CREATE TABLE AS in the session catalog; ``path`` makes it an external
    table at that location (e.g. the shared checkpoint folder)."""
    w = df.write.mode("overwrite")
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """CREATE VIEW: a lazy, inlined temp view."""
    df.createOrReplaceTempView(name)
    return df


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header, one file per partition. ``single_file`` puts the rows
    into one task and is for small reports (the KPI table)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path
