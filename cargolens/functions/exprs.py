"""Column expressions shared by the queries.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen. Conventions that keep results identical to the SQL oracle:

* money stays DECIMAL until the final projection; sums are exact;
* averages of money are ``sum / count`` on the exact sum;
* every displayed, rounded figure goes through :func:`rnd`, which rounds on a
  DECIMAL (half away from zero, like PostgreSQL numeric) instead of on a
  double, whose rounding differs between engines at decimal ties;
* divisions are guarded so ANSI mode never raises on a zero denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000.0
US_PER_HOUR = 3_600_000_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int) -> Column:
    """ROUND(x, digits) as PostgreSQL does it on numeric, returned as double."""
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def pct(num: str | Column, den: str | Column) -> Column:
    """100 * num / den as double; NULL when den is 0."""
    return F.try_divide(as_double(num) * F.lit(100.0), as_double(den))


def avg_exact(c: str | Column) -> Column:
    """Mean of a DECIMAL or integer column from its exact sum."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def count_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): 0, never NULL, on no match."""
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("long")


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def days_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in fractional days, like EXTRACT(EPOCH ...) / 86400."""
    return micros_between(start, end).cast("double") / F.lit(US_PER_DAY)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end).cast("double") / F.lit(US_PER_HOUR)


def dow_sunday0(ts: str | Column) -> Column:
    """EXTRACT(DOW ...): 0 = Sunday."""
    return (F.dayofweek(col(ts)) - 1).cast("int")


def dow_monday0(ts: str | Column) -> Column:
    """pandas ``dt.dayofweek``: 0 = Monday."""
    return F.weekday(col(ts)).cast("int")


def month_start(ts: str | Column) -> Column:
    return F.trunc(col(ts).cast("date"), "month")


def week_start(ts: str | Column) -> Column:
    """Monday of the week, as DATE_TRUNC('week', ...) gives it."""
    return F.trunc(col(ts).cast("date"), "week")


def pmod(c: str | Column, n: int | Column) -> Column:
    return F.pmod(col(c), n if isinstance(n, Column) else F.lit(n))


def bands(value: str | Column, edges: Sequence[tuple[str, str, float]],
          otherwise: str | None) -> Column:
    """A CASE chain from data: edges are (op, label, bound), op in <, <=, >, >=.

    The first matching edge wins, as in a searched CASE; NULL falls through to
    ``otherwise``, like the SQL it mirrors.
    """
    v = col(value)
    ops = {"<": v.__lt__, "<=": v.__le__, ">": v.__gt__, ">=": v.__ge__}
    expr = None
    for op, label, bound in edges:
        cond = ops[op](F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if otherwise is not None:
        expr = expr.otherwise(F.lit(otherwise))
    return expr


def right_closed_bins(value: str | Column, edges: Sequence[float],
                      labels: Sequence[str]) -> Column:
    """pandas ``cut(x, bins=edges, labels=labels)``: (e0, e1], (e1, e2], ...

    Values outside (e0, e_last] and NULL give NULL.
    """
    assert len(labels) == len(edges) - 1
    v = col(value)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (v > F.lit(lo)) & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def ordinal_of(value: Column, labels: Sequence[str]) -> Column:
    """Position (1-based) of a label, to sort categorical bins in their order."""
    expr = None
    for i, label in enumerate(labels, start=1):
        cond = value == F.lit(label)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
