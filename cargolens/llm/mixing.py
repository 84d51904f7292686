"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of the corpus. A source whose share is above
the epochs it may be repeated is clamped there, and the excess goes to the
others in proportion to their weights until none is above. That ends at one
water level: the target is the weight times the level, or the cap if that is
lower, and sorting sources by cap over weight gives the level in one pass.

A target is met by whole repetitions of the source and a seeded sample of it:
documents in the order of a hash, taken until the words are full, the last one
as far as needed. The running total is kept in two steps, over ranges of the
hash and inside each, so a source with any share of the rows is spread out.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, one_of_each, row_hashes, spare_names, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Leading hex digits of the hash that name a range of the sample's order.
RANGE_DIGITS = 3
#: Copies of one row that one task writes.
LOT = 1000


def order_key(doc_id: Column, seed: int) -> Column:
    """Place of a document in its source's sampling order; rows that share an id share it."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of ``sources`` (source, source_size), one row each: adds weight and target.

    ``weights`` repeat over the sources in code point order, null last. The
    targets add up to all sizes, unless every source is at its cap. Sources
    without words get none. The windows are over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.array(*[F.lit(float(w)) for w in weights])[nth]
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sources.withColumn("weight", weight).withColumn("cap", cap)
    # Sources that fill up first come first; the level if all before a source are full.
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - full) / (F.sum("weight").over(whole) - used)
    # Filling a source that stays below its cap would lower the level, so the highest is the one reached.
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
        also: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, the columns of ``also``, size (words of the text),
    source_size, target (of the source), copies (whole repetitions), extra (words of one more,
    partial or whole) and taken = copies * size + extra.

    The words taken of a source are its target, rounded. Null texts have no
    words and are not taken; a null source is a source, the last one; null ids
    count as ''. Repeated rows take places of their own in the order. An empty
    table gives an empty frame, and without any words all targets are zero.
    Columns not named are not read.
    """
    # Names of its own, so that columns in ``also`` may be called anything.
    rows = docs.select(F.col(doc_id).alias("m_id"), F.col(source).alias("source"), *[F.col(c) for c in also],
                       word_count(F.col(text)).alias("size"), order_key(F.col(doc_id), seed).alias("m_key"))
    rows = cut(rows.withColumn("m_range", F.substring("m_key", 1, RANGE_DIGITS)))
    ranges = rows.groupBy("source", "m_range").agg(F.sum("size").alias("range_size"))
    targets = water_fill(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("copies", copies).withColumn(
        "part", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    over_ranges = Window.partitionBy("source").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(over_ranges), F.lit(0)))
    t, r = targets.withColumnRenamed("source", "t_source"), ranges.withColumnRenamed("source", "r_source")
    plan = cut(r.join(t, F.col("r_source").eqNullSafe(F.col("t_source"))).select(
        F.col("r_source"), F.col("m_range").alias("r_range"), "source_size", "target", "copies", "part", "range_before"))
    in_range = Window.partitionBy("source", "m_range").orderBy("m_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("m_range") == F.col("r_range")))
    left = F.col("part") - F.col("range_before") - F.col("before")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    return rows.withColumn("extra", extra).select(
        F.col("m_id").alias(doc_id), "source", *also, "size", "source_size", "target", "copies", "extra",
        (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"))


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                     **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with all its columns.

    Rows are taken whole: the document at the end of a source's sample, of which ``mix`` takes a part, appears once more if that
    part is half of its words or more, so that the source comes as near to its target as whole documents can. Documents not
    taken go. Rows that repeat count together.
    """
    row = spare_names(docs, "m_row", "m_twin")
    (nth,) = spare_names(docs, "m_nth")
    marked = docs.withColumns(dict(zip(row, row_hashes(docs))))
    taken = mix(marked, doc_id, source, text, also=row, **options).where("taken > 0")
    # What the copies of a row take together: whole repetitions of each, and of one more as many as fit.
    times = F.col("whole") + F.floor((F.col("extra") * 2 + F.col("size")) / (F.col("size") * 2))
    taken = cut(taken.groupBy(*row).agg(F.max("size").alias("size"), F.sum("copies").alias("whole"), F.sum("extra").alias("extra"))
                .select(*row, times.cast("long").alias("times")).where("times > 0"))
    rows = one_of_each(marked, row).join(taken, row)
    few = rows.where(F.col("times") <= LOT).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    # A row taken very often is dealt out in lots before its copies are written.
    lots = rows.where(F.col("times") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LOT)))).repartition("lot", *row)
    many = lots.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT), F.col("times") - F.col("lot") * LOT))))
    return few.select("kept.*").unionByName(many.select("kept.*"))


def op3_mixing(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of every document, as its contract names them."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS place
    FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
    SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
           {float(MAX_EPOCHS)}::DOUBLE * source_size AS cap
    FROM sized),
-- the level at which the capped sources of each size, and all that fill up before them, are full
levels AS (
    SELECT max((t.total - coalesce(f.cap, 0)) / (t.weight - coalesce(f.weight, 0))) AS level
    FROM (SELECT sum(source_size) AS total, sum(weight) AS weight FROM weighed) t,
         weighed w LEFT JOIN LATERAL (
             SELECT sum(x.cap) AS cap, sum(x.weight) AS weight FROM weighed x
             WHERE x.cap / x.weight < w.cap / w.weight) f ON true),
targets AS (SELECT source, source_size, least(cap, weight * level) AS target FROM weighed, levels),
placed AS (
    SELECT d.*, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS copies,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (copies * size + greatest(0, least(size, round(target - copies * source_size) - before)))::BIGINT AS taken
FROM placed
"""
