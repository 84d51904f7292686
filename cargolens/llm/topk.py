"""Exact top-k search by distributed histogram selection.

Queries and candidates meet in blocks: a pair of blocks is one row of work, and its
task scores it with one integer matrix product. Nothing stores the scores. A
first pass counts them in coarse bins, per query and over all blocks; the bin
that holds a query's kth score is divided into finer bins and counted again, until a bin is
a single score. That score is the query's threshold: a last pass keeps what reaches
it, and the ties at the threshold go to the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, is_query, matrix, same_width, usable

TOP = 20
SCALE = 64
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
#: Bins into which a pass divides a query's range of scores.
BINS = 256
PAIRS = "q_block long, q_ids array<long>, q array<array<long>>, c_ids array<long>, c array<array<long>>"


def quantise(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component)."""
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("x"))


def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """One row for each block of about ``size`` vectors (number, ids, matrix), and how many there are at most."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{name}_block")).agg(
        F.collect_list(F.struct("vec_id", "x")).alias("rows")).select(
        f"{name}_block", F.col("rows.vec_id").alias(f"{name}_ids"), F.col("rows.x").alias(name)), n


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of queries with every block of candidates, each pair on its own key."""
    (q, n_q), (c, n_c) = blocks(queries, QUERY_BLOCK, "q"), blocks(candidates, CANDIDATE_BLOCK, "c")
    q, c = cut(q), cut(c)
    return q.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1).cast("long")))).join(
        c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1).cast("long")))), ["q_block", "c_block"])


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these hold every sum exactly, else in 64-bit integers."""
    q, c = same_width(q, c)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks: the other columns, ids, scores and which of them count (not a query with itself)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            q_ids, c_ids = (row[c].values.to_numpy() for c in ("q_ids", "c_ids"))
            s = product(matrix(row["q"].values), matrix(row["c"].values))
            yield row, q_ids, c_ids, s, q_ids[:, None] != c_ids[None, :]


def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, q_ids, _, s, counts in scored(batches):
        some = counts.any(axis=1)
        low, high = np.where(counts, s, np.iinfo(np.int64).max).min(axis=1), np.where(counts, s, np.iinfo(np.int64).min).max(axis=1)
        yield pa.record_batch({"query_id": q_ids[some], "low": low[some], "high": high[some], "n": counts.sum(axis=1)[some]})


def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper bins of each query's present range [low, high], as counted in a pair of blocks.

    With the scores of one block alone the bin sought would be the one that
    reaches the number wanted from the top; more scores only move it up. Bins below
    that one cannot be it, and are not sent.
    """
    for row, q_ids, _, s, counts in scored(batches):
        low, high, width, want = (row[c].values.to_numpy()[:, None] for c in ("low", "high", "width", "want"))
        place, at = np.nonzero(counts & (s >= low) & (s <= high))
        number = ((s[place, at] - low[place, 0]) // width[place, 0])
        n = np.bincount(place * BINS + number, minlength=len(q_ids) * BINS).reshape(-1, BINS)
        above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
        query, at = np.nonzero((n > 0) & (above < want))
        yield pa.record_batch({"query_id": q_ids[query], "bin": at, "n": n[query, at]})


def winners(k: int):
    def at_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q_ids, c_ids, s, counts in scored(batches):
            query, place = np.nonzero(counts & (s >= row["low"].values.to_numpy()[:, None]))
            s = s[query, place]
            # Of the ties at the threshold no block has more than k to give.
            top = best(query, s, c_ids[place], k)
            yield pa.record_batch({"query_id": q_ids[query[top]], "vec_id": c_ids[place[top]], "score": s[top]})
    return at_least


def with_state(pairs: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Block pairs with the queries' ranges in the order of q_ids."""
    by_block = state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("s")).select(
        "q_block", *[F.col(f"s.{c}").alias(c) for c in columns])
    return pairs.join(by_block, "q_block")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over
    the candidates (all, if fewer), without itself, ties to the smaller id.

    Both frames: (vec_id long, x array<long>) with different ids. A vector shorter than another counts as
    filled up with zeros. Scores are 64-bit integers. No candidates or no queries give an empty frame.
    """
    pairs = block_pairs(queries, candidates)
    rows = pairs.select("q_block", "q_ids", "q", "c_ids", "c")
    ranges = rows.mapInArrow(span, "query_id long, low long, high long, n long").groupBy("query_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    places = pairs.select("q_block", F.posexplode("q_ids").alias("place", "query_id")).distinct()
    # want: how many scores of the present range belong to the answer
    state = cut(places.join(ranges, "query_id", "left").select(
        "q_block", "place", "query_id", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(-1)).alias("high"),
        F.least(F.coalesce("n", F.lit(0)), F.lit(k)).alias("want")))
    while True:
        width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / BINS)).cast("long")
        state = state.withColumn("width", width)
        open_ = state.where("high > low and want > 0").groupBy("q_block").agg(F.count(F.lit(1)).alias("n"))
        if open_.isEmpty():
            break
        bins = with_state(rows.join(open_.select("q_block"), "q_block", "left_semi"), state, ["low", "high", "width", "want"]).mapInArrow(
            histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, 0))
        found = bins.withColumn("reached", reached).join(state.select("query_id", "low", "high", "width", "want"), "query_id")
        found = found.where((F.col("reached") >= F.col("want")) & (F.col("reached") - F.col("n") < F.col("want"))).select(
            "query_id", (F.col("low") + F.col("bin") * F.col("width")).alias("new_low"),
            F.least("high", F.col("low") + (F.col("bin") + 1) * F.col("width") - 1).alias("new_high"),
            (F.col("want") - F.col("reached") + F.col("n")).alias("new_want"))
        state = cut(state.join(found, "query_id", "left").select(
            "q_block", "place", "query_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("low", "high", "want")]))
    kept = with_state(rows, state, ["low"]).mapInArrow(winners(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op5_topk(embeddings: DataFrame) -> DataFrame:
    """The 20 highest scores of every query row, as its contract names them.

    Rows without an id, without a vector or with a null or non-finite component take no part; rows
    that repeat an id count once (see ``vectors.usable``); other columns are not read.
    """
    rows = cut(quantise(usable(embeddings)))
    return top_k(rows.where(is_query(F.col("vec_id"))), rows)


ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= {TOP}
"""
