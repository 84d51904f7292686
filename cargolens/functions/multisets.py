"""Rows as multisets: INTERSECT and EXCEPT, distinct and ALL, and what changed between two loads of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, for counting rows without shuffling them."""
    return [F.xxhash64(*_named(df)).alias("_h1"), F.xxhash64(F.lit("twin"), *_named(df)).alias("_h2")]


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every different row of both with its number on each side; counted map-side, so a row that repeats without end is one row a task.

    The rows are structs, by which neither side is partitioned. Sides that are partitioned alike would be put together partition by
    partition, and all that made both and counts them would hold its rows in one task.
    """
    types = [f.dataType for f in a.union(b).schema]

    def side(df: DataFrame, na: int, nb: int) -> DataFrame:
        row = F.struct(*[c.cast(t).alias(name) for c, t, name in zip(_named(df), types, a.columns)])
        return df.select(row.alias("_row"), F.lit(na).alias("_a"), F.lit(nb).alias("_b"))

    both = side(a, 1, 0).union(side(b, 0, 1))
    return both.groupBy("_row").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).select("_row.*", "_a", "_b")


#: Copies of one row that one task writes.
LOT = 1000


def _times(counted: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times; a row of very many copies is dealt out in lots before they are written."""
    columns = [F.col(f"`{c}`") for c in counted.columns if c not in ("_a", "_b")]
    counted = counted.withColumn("_n", n.cast("long"))
    few = counted.where(F.col("_n").between(1, LOT)).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    lots = counted.where(F.col("_n") > LOT).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / LOT))))
    many = lots.repartition("_lot", *columns).withColumn(
        "_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT), F.col("_n") - F.col("_lot") * LOT))))
    return few.select(*columns).unionByName(many.select(*columns))


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows of both; ``every``: as often as both have them (INTERSECT ALL). Nulls are equal."""
    c = _counted(a, b)
    if every:
        return _times(c, F.least("_a", "_b"))
    return c.where("_a > 0 and _b > 0").drop("_a", "_b")


def subtract(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows of ``a`` that ``b`` has not; ``every``: as often as ``a`` has them more (EXCEPT ALL)."""
    c = _counted(a, b)
    return _times(c, F.col("_a") - F.col("_b")) if every else c.where("_b = 0").drop("_a", "_b")


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key that differs between two loads: key, ``change`` (added, removed, changed), ``rows_removed`` and ``rows_added``
    with their multiplicity.

    Rows are counted by hash and key; the rows themselves don't move. Two different rows of a key that
    agree in both hashes would count as one (some 1e-20 for a billion rows of one key). The key is a struct for the reason
    given at ``_counted``.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        df = df.select(*[F.col(f"`{c}`") for c in old.columns])
        return df.select(F.struct(*key).alias("_key"), *row_hash(df), F.lit(sign).alias("_s"))

    net = side(old, -1).union(side(new, 1)).groupBy("_key", "_h1", "_h2").agg(F.sum("_s").alias("_net"), F.count_if(F.col("_s") < 0).alias("_old"))
    per_key = net.select("_key.*", "_net", "_old").groupBy(*key).agg(
        F.sum(F.greatest(-F.col("_net"), F.lit(0))).alias("rows_removed"), F.sum(F.greatest("_net", F.lit(0))).alias("rows_added"), F.sum("_old").alias("_old"))
    # The key's present rows are the earlier ones less rows_removed plus rows_added.
    change = F.when(F.col("_old") == 0, "added").when(F.col("_old") - F.col("rows_removed") + F.col("rows_added") == 0, "removed").otherwise("changed")
    return per_key.where("rows_removed + rows_added > 0").select(*key, change.alias("change"), "rows_removed", "rows_added")
