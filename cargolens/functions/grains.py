"""One pass at several grains: GROUPING SETS, CUBE and ROLLUP with exact distinct counts that merge."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def grouping_sets(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], sums: dict[str, Column], distinct: str, name: str,
                  level: str = "level") -> DataFrame:
    """``dims``, ``level`` (GROUPING_ID: a bit for each dimension left out, the first the highest), ``sums`` and the number of
    different non-null values of ``distinct``, for every set of dimensions.

    Rows are first added up per (dims, distinct), map-side; only those are laid out for the sets. A second aggregate makes one row per set, group and
    value, a third counts them: every step combines before its shuffle, so the grand total is no task that sees all rows. A
    null dimension is a group of its own; ``level`` tells it from a subtotal. Amounts keep their type.
    """
    fine = rows.groupBy(*dims, distinct).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = fine.groupingSets([[*(F.col(d) for d in s), F.col(distinct)] for s in sets], *[F.col(d) for d in dims], F.col(distinct))
    # The id of all columns has a lowest bit for ``distinct``, which every set keeps.
    per_value = each.agg(F.shiftright(F.grouping_id(), 1).cast("int").alias(level), *[F.sum(n).alias(n) for n in sums])
    out = per_value.groupBy(*dims, level).agg(*[F.sum(n).alias(n) for n in sums], F.count(distinct).alias(name))
    return out.select(*dims, level, *[F.col(n).cast(fine.schema[n].dataType).alias(n) for n in sums], name)
