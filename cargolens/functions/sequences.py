"""Ordered work per key: as-of joins, LAG and LEAD, running and trailing totals, sessions, interval joins.

A plain window hands all rows of a key to one task. Here a key with more than ``most`` rows is cut into
time slices first: rows are counted per key, and for the large keys per ``unit`` of time, with map-side combine; consecutive units are put together to
slices of about ``most`` rows, and the windows run per (key, slice). What a slice needs from those before it (the last
value, the total so far) is one row for each slice, worked out from per-slice aggregates and handed on. Keys
without so many rows are one slice and pay for the count only. A single unit isn't cut, so choose one in which no key has too many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows of a key in one slice, about.
SLICE_ROWS = 1_000_000
#: A frame of (key, unit, slice) rows of at most this size is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
SLICE = "_slice"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _kept(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Slices:
    """The time slices of the keys with many rows, over all frames that share the sequence.

    ``frames``: (frame, name of its time column) pairs; all have the key columns ``by``. Times are timestamps (with or without zone).
    """

    def __init__(self, frames: Sequence[tuple[DataFrame, str]], by: Sequence[str], most: int = SLICE_ROWS, unit: str = "day"):
        self.by, self.unit = list(by), unit
        timed = None
        for df, time in frames:
            one = df.select(*self.by, F.date_trunc(unit, F.col(time)).alias("_unit"))
            timed = one if timed is None else timed.unionByName(one)
        timed = timed.where(F.col("_unit").isNotNull())
        # First the keys with many rows, mostly none; units of time are counted for those alone.
        large = _kept(timed.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_total")).where(F.col("_total") > most))
        self.units, self.rows, n = large, 0, large.count()
        if n:
            counts = timed.join(_small(large, n), self.by).groupBy(*self.by, "_unit").agg(F.count(F.lit(1)).alias("_n"))
            so_far = Window.partitionBy(*self.by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            self.units = _kept(counts.select(*self.by, "_unit", F.floor((F.sum("_n").over(so_far) - 1) / most).alias(SLICE)))
            self.rows = self.units.count()

    def __bool__(self) -> bool:
        return self.rows > 0

    def mark(self, df: DataFrame, time: str) -> DataFrame:
        """``df`` with its slice; 0 for keys that are not cut and rows without a time."""
        if not self:
            return df.withColumn(SLICE, F.lit(0).cast("long"))
        marked = df.withColumn("_unit", F.date_trunc(self.unit, F.col(time)))
        marked = marked.join(_small(self.units, self.rows), [*self.by, "_unit"], "left").drop("_unit")
        return marked.withColumn(SLICE, F.coalesce(SLICE, F.lit(0).cast("long"))).select(*df.columns, SLICE)

    def names(self) -> DataFrame:
        """(key, slice) of the keys that are cut."""
        return self.units.select(*self.by, SLICE).distinct()

    def handed_on(self, marked: DataFrame, value: Column, ahead: bool = False) -> DataFrame:
        """(key, slice, ``_handed``): ``value``, an aggregate over the slice's rows, of the last slice before it that has one."""
        has = marked.join(_small(self.names(), self.rows), [*self.by, SLICE], "left_semi")
        per_slice = self.names().join(has.groupBy(*self.by, SLICE).agg(value.alias("_value")), [*self.by, SLICE], "left")
        order = Window.partitionBy(*self.by).orderBy(F.desc(SLICE) if ahead else F.asc(SLICE))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return per_slice.select(*self.by, SLICE, F.last("_value", ignorenulls=True).over(before).alias("_handed"))

    def with_handed(self, marked: DataFrame, value: Column, ahead: bool = False) -> DataFrame:
        return marked.join(_small(self.handed_on(marked, value, ahead), self.rows), [*self.by, SLICE], "left")


def neighbour(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, ahead: bool = False,
              most: int = SLICE_ROWS, unit: str = "day", slices: Slices | None = None) -> DataFrame:
    """``df`` with a struct ``name`` of ``columns`` of the row before (LAG) or, with ``ahead``, after (LEAD) it in its key; null at the end.

    ``order`` starts with the time column and should tell rows apart; rows without a time come first.
    """
    slices = Slices([(df, order[0])], by, most, unit) if slices is None else slices
    marked = slices.mark(df, order[0])
    w = Window.partitionBy(*by, SLICE).orderBy(*order)
    row = F.struct(*columns)
    found = (F.lead if ahead else F.lag)(row).over(w)
    if not slices:
        return marked.withColumn(name, found).drop(SLICE)
    edge = F.struct(*order, row.alias("_row"))
    out = slices.with_handed(marked, F.min(edge) if ahead else F.max(edge), ahead)
    return out.withColumn(name, F.coalesce(found, F.col("_handed._row"))).drop(SLICE, "_handed")


def running_total(df: DataFrame, by: Sequence[str], time: str, value: Column, name: str, most: int = SLICE_ROWS, unit: str = "day",
                  slices: Slices | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over its key's rows up to its time: rows of the same time included, or, with an ``order``
    that tells them apart, row by row."""
    slices = Slices([(df, time)], by, most, unit) if slices is None else slices
    marked = slices.mark(df.withColumn("_add", value), time)
    w = Window.partitionBy(*by, SLICE).orderBy(time, *order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if order else w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.sum("_add").over(w)
    if not slices:
        return marked.withColumn(name, here).drop(SLICE, "_add")
    sums = marked.join(_small(slices.names(), slices.rows), [*by, SLICE], "left_semi").groupBy(*by, SLICE).agg(F.sum("_add").alias("_s"))
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, SLICE, F.sum("_s").over(before).alias("_offset"))
    kind = marked.select(F.sum("_add").alias("s")).schema["s"].dataType
    out = marked.join(_small(offsets, slices.rows), [*by, SLICE], "left").withColumn("_here", here)
    total = F.when(F.col("_here").isNotNull() | F.col("_offset").isNotNull(),
                   F.coalesce("_here", F.lit(0)) + F.coalesce("_offset", F.lit(0))).cast(kind)
    return out.withColumn(name, total).drop(SLICE, "_add", "_here", "_offset")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], right_time: str | None = None,
              tie: Sequence[str] = (), inclusive: bool = True, most: int = SLICE_ROWS, unit: str = "day") -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` of its key that is not later (``inclusive``) or that is earlier.

    Of right rows of one time the last by ``tie`` counts. Both sides have the key columns ``by``. Where nothing fits, and for left rows with a
    null key or time, the values are null. One sorted pass over both sides together; no row meets more than its predecessor.
    """
    right_time = right_time or time
    key = [f"_k{i}" for i in range(len(by))]
    rest = ["_t", "_side", "_tie", "_l", "_r"]
    row, found = F.struct(*left.columns), F.struct(*values)
    tie_of = F.struct(F.lit(0).alias("_"), *tie)
    kinds = {"_l": left.select(row.alias("s")).schema["s"].dataType, "_r": right.select(found.alias("s")).schema["s"].dataType,
             "_tie": right.select(tie_of.alias("s")).schema["s"].dataType}
    null = {c: F.lit(None).cast(t).alias(c) for c, t in kinds.items()}
    some = [F.col(c).isNotNull() for c in key] + [F.col("_t").isNotNull()]
    whole = some[0]
    for c in some[1:]:
        whole = whole & c
    keys = [F.col(c).alias(k) for c, k in zip(by, key)]
    l = left.select(*keys, F.col(time).alias("_t"), F.lit(1 if inclusive else -1).alias("_side"), null["_tie"], row.alias("_l"), null["_r"])
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), tie_of.alias("_tie"), null["_l"], found.alias("_r")).where(whole)
    timed = l.where(whole)
    slices = Slices([(timed, "_t"), (r, "_t")], key, most, unit)
    both = slices.mark(timed.unionByName(r), "_t")
    if slices:
        # The last right row before a slice stands at its start as if it were one of the slice's own.
        last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_r")))
        first = slices.handed_on(both.where("_side = 0"), last).where("_handed is not null").select(
            *key, F.lit(None).cast(both.schema["_t"].dataType).alias("_t"), F.lit(-2).alias("_side"), F.col("_handed._tie").alias("_tie"),
            null["_l"], F.col("_handed._r").alias("_r"), SLICE)
        both = both.unionByName(first)
    w = Window.partitionBy(*key, SLICE).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.select(*key, *rest, F.last("_r", ignorenulls=True).over(w).alias("_found")).where("_l is not null").select("_l", "_found")
    untimed = l.where(~F.coalesce(whole, F.lit(False))).select("_l", F.col("_r").alias("_found"))
    return joined.unionByName(untimed).select("_l.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def trailing_total(df: DataFrame, by: Sequence[str], time: str, value: Column, days: int, name: str, most: int = SLICE_ROWS, unit: str = "day") -> DataFrame:
    """``df`` with the sum of ``value`` over its key's rows of the last ``days`` days and its own time:
    SUM(value) OVER (PARTITION BY by ORDER BY time RANGE BETWEEN INTERVAL days DAYS PRECEDING AND CURRENT ROW).

    Keys that are cut into slices take the total up to a row less the total before its frame, which an as-of join finds; the sums
    of a decimal or integer ``value`` stay exact. Rows of ``df`` need a time.
    """
    slices = Slices([(df, time)], by, most, unit)
    plain = F.expr(f"sum(_v) OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY `{time}` RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW)")
    rows = df.withColumn("_v", value)
    if not slices:
        return rows.withColumn(name, plain).drop("_v")
    cut = slices.units.select(*by).distinct()
    cold = rows.join(_small(cut, slices.rows), list(by), "left_anti").withColumn(name, plain).drop("_v")
    hot = rows.join(_small(cut, slices.rows), list(by), "left_semi")
    hot = running_total(hot, by, time, F.col("_v"), "_upto", slices=slices)
    hot = running_total(hot, by, time, F.when(F.col("_v").isNotNull(), 1).otherwise(0), "_n_upto", slices=slices)
    start = F.col(time) - F.make_dt_interval(F.lit(days))
    totals = hot.groupBy(*by, time).agg(F.max("_upto").alias("_before"), F.max("_n_upto").alias("_n_before"))
    found = asof_join(hot.withColumn("_start", start), totals, by, "_start", ["_before", "_n_before"], right_time=time, inclusive=False,
                      most=most, unit=unit)
    # A frame without values has no sum.
    some = F.col("_n_upto") > F.coalesce("_n_before", F.lit(0))
    total = F.when(some, F.col("_upto") - F.coalesce("_before", F.lit(0))).cast(cold.schema[name].dataType)
    return cold.unionByName(found.withColumn(name, total).drop("_v", "_upto", "_n_upto", "_before", "_n_before", "_start"))


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str], gap_days: float, name: str = "session_no", most: int = SLICE_ROWS,
             unit: str = "day") -> DataFrame:
    """``df`` with the number (from 1) of its key's session: a row more than ``gap_days`` after the one before it starts a new one."""
    slices = Slices([(df, order[0])], by, most, unit)
    before = neighbour(df, by, order, [order[0]], "_before", slices=slices)
    apart = F.timestamp_diff("MICROSECOND", F.col(f"_before.{order[0]}"), F.col(order[0])) > int(gap_days * 86_400_000_000)
    starts = F.when(F.col("_before").isNull() | apart, 1).otherwise(0)
    return running_total(before.withColumn("_starts", starts), by, order[0], F.col("_starts"), name, slices=slices, order=order[1:]).drop("_before", "_starts")


# ------------------------------------------------------------- intervals --

#: Width of the finest bins, in microseconds, and how much wider the bins of the next level are.
BIN, WIDER = 3_600_000_000, 4


def _binned(df: DataFrame, by: Sequence[str], start: str, end: str, prefix: str) -> DataFrame:
    """Key, start and end in microseconds, the whole row, and the level whose bins are at least as wide as the interval."""
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    rows = df.select(*by, micros(start).alias(f"{prefix}_from"), micros(end).alias(f"{prefix}_to"), F.struct(*df.columns).alias(prefix))
    length = F.greatest(F.col(f"{prefix}_to") - F.col(f"{prefix}_from"), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(length / BIN) / F.log(F.lit(float(WIDER))) - 1e-9)).cast("int")
    # Empty intervals overlap nothing; a rounded logarithm may be one level short, which costs a bin more and no result.
    return rows.where(F.col(f"{prefix}_to") > F.col(f"{prefix}_from")).withColumn(f"{prefix}_level", level)


def _spread(rows: DataFrame, prefix: str, others: list[int]) -> DataFrame:
    """A row for each bin that the interval touches, on its own level and on the other side's wider ones."""
    own = F.col(f"{prefix}_level")
    levels = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > own)))
    rows = rows.withColumn("_level", F.explode(levels))
    width = F.lit(BIN) * F.pow(F.lit(WIDER), F.col("_level")).cast("long")

    def bin_of(c: Column) -> Column:
        return F.floor(c / width).cast("long")

    first, last = bin_of(F.col(f"{prefix}_from")), bin_of(F.col(f"{prefix}_to") - 1)
    return rows.withColumn(f"{prefix}_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """(key, ``l``, ``r``): structs of the rows of both sides whose half-open intervals [start, end) of one key have an instant in common.

    An equi-join on key, level and bin: an interval lies on the level whose bins are at least as wide as it, so that it touches two or
    three of them whatever its length, and looks into the bins of the other side's wider levels; levels are a handful, as widths grow
    fourfold. A pair that meets in two bins counts in the one where the later of both begins. Intervals without a
    start or end, or that end no later than they start, match nothing. A key with many rows is divided by its bins.
    """
    a, b = _binned(left, by, *left_span, "l"), _binned(right, by, *right_span, "r")
    # At most some 20 levels: a bounded collect.
    levels_a, levels_b = (sorted(x[0] for x in d.select(f"{p}_level").distinct().collect()) for d, p in ((a, "l"), (b, "r")))
    a, b = _spread(a, "l", levels_b), _spread(b, "r", levels_a)
    met = a.join(b, [*by, "_level", "_bin"]).where(
        (F.col("_level") == F.greatest("l_level", "r_level")) & (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to"))
        & (F.col("_bin") == F.greatest("l_first", "r_first")))
    return met.select(*by, "l", "r")


def overlap_counts(df: DataFrame, by: Sequence[str], start: str, end: str, name: str, most: int = SLICE_ROWS, unit: str = "day") -> DataFrame:
    """``df`` with the number of other rows of its key whose half-open interval has an instant in common with its own.

    No pair is made: those that overlap are those that start before this one ends, less those that end by its start, less itself. Every interval
    stands twice in one sequence of its key, where it ends and where it starts, ends first where both fall on one instant; what has begun is
    counted up to each end and what has ended up to each start, and the two meet by key, start and end. A row's other columns only travel along,
    so those that a query doesn't use are not read. Intervals without a key, start or end, or that end no later than they start, overlap
    nothing and get 0. Linear in the rows, however many of a key overlap.
    """
    valid = F.coalesce(F.col(end) > F.col(start), F.lit(False))
    for c in by:
        valid = valid & F.col(c).isNotNull()
    at = F.array(F.struct(F.col(end).alias("_at"), F.lit(0).alias("_starts")), F.struct(F.col(start).alias("_at"), F.lit(1).alias("_starts")))
    events = df.where(valid).withColumn("_event", F.explode(at)).select(*df.columns, "_event.*")
    slices = Slices([(events, "_at")], by, most, unit)
    begun, ended = F.col("_starts").cast("long"), (1 - F.col("_starts")).cast("long")
    events = running_total(events, by, "_at", begun, "_begun", slices=slices, order=["_starts"])
    events = running_total(events, by, "_at", ended, "_ended", slices=slices, order=["_starts"])
    # Intervals of one start and end have the same numbers, so any of them may give those of the start.
    same = Window.partitionBy(*by, start, end)
    events = events.withColumn("_ended", F.max(F.when(F.col("_starts") == 1, F.col("_ended"))).over(same)).where("_starts = 0")
    out = events.select(*df.columns, (F.col("_begun") - F.col("_ended") - 1).cast("long").alias(name))
    return out.unionByName(df.where(~valid).withColumn(name, F.lit(0).cast("long")))
