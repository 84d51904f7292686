"""Approximate nearest neighbours by cross-polytope hashing.

Vectors of unequal length get one coordinate more, which fills them up to the longest; queries have 0 there, so that the
largest inner product is the nearest angle. A table rotates the unit vectors by three rounds of random signs and a fast Hadamard
transform and puts each into the bucket of its largest coordinate, with the sign: the
nearest of the 2d signed axes. A query looks, per table, into the buckets of the axes
nearest to it. All buckets together are the index; every row is in one bucket
of each table. How many buckets a query looks into is fitted on a bounded
sample to the recall asked for, and then holds for all.

What a query finds is reranked by the exact inner product of the original vectors. That
is done where the bucket lies: a bucket's members meet the queries that look into it as
matrices, and only a query's best of each bucket go on. Large buckets, and large
groups of queries for one, are cut into parts, each pair of parts a row of work of its own.

Equal vectors are one entry of the index: at most k + 1 of the rows that share a vector, those of
smallest id, can be among anyone's k nearest, so the others need not be searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, is_query, matrix, same_width, usable

TOP = 20
TABLES = 8
SEED = 11
#: Recall to fit for on the sample, above the 0.9 to be reached; rows and queries of the sample.
RECALL, SAMPLE_ROWS, SAMPLE_QUERIES = 0.96, 4096, 128
MEMBERS, LOOKERS = 2048, 1024
LENGTH_SCALE = 2.0**-16
#: Vectors whose lengths differ by no more than this share count as equally long.
SAME_LENGTH = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def length(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, scaled down so that none overflows."""
    most = np.abs(x).max(axis=1)
    return most * LENGTH_SCALE * np.linalg.norm(x / most[:, None], axis=1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows as they are hashed: scaled so that the longest has length one, and filled up to that in the last, spare
    coordinate. Queries have 0 there, so that the nearest angle is the largest inner product."""
    share = np.minimum(length(x) / longest, 1)
    out = unit(x) * share[:, None]
    out[:, -1] = np.sqrt(1 - share**2)
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """A table's pseudo-rotation of the rows of ``x``, filled up to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for signs in np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (3, d)):
        x = hadamard(x * signs)
    return x


def axes(x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: 2 * coordinate + (1 if negative)."""
    r = rotate(x, table)
    both = np.stack([r, -r], axis=2).reshape(len(r), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def fit_probes(rows: DataFrame, n: int, width: int, k: int, longest: float | None = None) -> int:
    """Buckets to look into per table, so that the sample's neighbours are found with the recall asked for.

    Among a sample of s of n rows, the k * s / n of largest inner product are about as good as the k best of all.
    ``longest``: the greatest length if lengths differ.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("x").toArrow()
    x = matrix(sample.column("x"), width)
    q = unit(x[:SAMPLE_QUERIES])
    x = unit(x) if longest is None else lifted(x, longest)  # q is 0 in the spare coordinate
    near = min(len(x) - 1, max(1, round(k * len(x) / n)))
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    neighbours = np.argsort(-s, axis=1)[:, :near]
    needed = np.full(neighbours.shape, 2 * width * 2)
    for t in range(TABLES):
        order = axes(q, t, probes=4 * width)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        home = axes(x, t)[:, 0]
        needed = np.minimum(needed, np.take_along_axis(place, home[neighbours], axis=1) + 1)
    return int(np.quantile(needed, RECALL, method="higher")) if needed.size else 1


def buckets(width: int, probes: int, tables: int = TABLES, longest: float | None = None):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), width)
                x = unit(x) if longest is None else lifted(x, longest)
                for t in range(tables):
                    found = axes(x, t, probes)
                    each = np.repeat(np.arange(len(x)), found.shape[1])
                    yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(each)),
                                           "x": batch.column("x").take(pa.array(each)),
                                           "bucket": pa.array(t * 4 * width + found.ravel())})
    return hashed


def parts(entries: DataFrame, size: int, name: str) -> DataFrame:
    """Matrices of up to about ``size`` entries of a bucket: bucket, part, ids, vectors."""
    entries = cut(entries)
    number = entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    # One row for each bucket of the tables, whatever the rows: 8 * 4 * width at most.
    own = F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias(f"{name}_part")
    return cut(entries.join(F.broadcast(number), "bucket").groupBy("bucket", own).agg(
        F.collect_list(F.struct("vec_id", "x")).alias("rows")).select(
        "bucket", f"{name}_part", F.col("rows.vec_id").alias(f"{name}_ids"), F.col("rows.x").alias(name)))


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component, so that equal vectors score equally everywhere."""
    s = np.zeros(len(q))
    for d in range(q.shape[1]):
        s += q[:, d] * c[:, d]
    return s


def rerank(k: int):
    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, c_ids = (batch.column(c)[i].values.to_numpy() for c in ("q_ids", "c_ids"))
                q, c = same_width(*(matrix(batch.column(c)[i].values) for c in ("q", "c")))
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = q @ c.T
                    slack = 1e-9 * (np.abs(q) @ np.abs(c).T + 1e-300)
                # The matrix product may round otherwise than the exact sum; what could still be among the best stays.
                least = np.partition(rough - slack, -k, axis=1)[:, -k] if len(c_ids) > k else np.full(len(q), -np.inf)
                query, place = np.nonzero(~(rough + slack < least[:, None]))
                s = exact(q[query], c[place])
                top = best(query, s, c_ids[place], k)
                yield pa.record_batch({"query_id": q_ids[query[top]], "vec_id": c_ids[place[top]], "score": s[top]})
    return reranked


def nearest(rows: DataFrame, queries: Column, k: int = TOP, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest found of each query row, without itself, largest
    inner product first, ties to the smaller id.

    ``rows``: (vec_id long, x array<double>) with different ids and vectors not zero; a shorter vector counts as filled
    up with zeros; ``queries`` says which rows are queries. The sign of zero makes no difference. A query whose buckets hold
    too few looks into more, in the end into all, so it gets fewer than k rows only where there are no more candidates.
    An empty frame gives an empty frame.
    """
    rows = cut(rows)
    most = F.array_max(F.transform("x", F.abs))
    long = most * LENGTH_SCALE * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / most) * (v / most)))
    n, width, shortest, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1)), F.min(long), F.max(long)).first()
    if n and shortest < longest * (1 - SAME_LENGTH):
        width += 1  # the spare coordinate
    else:
        longest = None
    width = 1 << max(0, width - 1).bit_length()
    same = Window.partitionBy("x").orderBy("vec_id")
    index = cut(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "x"))
    if probes is None:
        probes = fit_probes(index, n, width, k, longest) if n > 10 * k else 2 * width
    # Query rows with one vector search once, as the smallest of their ids.
    asking = rows.where(queries)
    first = cut(asking.groupBy("x").agg(F.min("vec_id").alias("asked_as")))
    members = parts(index.mapInArrow(buckets(width, 1, longest=longest), "vec_id long, x array<double>, bucket long"), MEMBERS, "c")
    # The numbers of parts have one row for each bucket of the tables, whatever the rows.
    c_parts = members.groupBy("bucket").agg((F.max("c_part") + 1).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    # One more than asked for: a query's own row may be among them.
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(askers: DataFrame, probes: int, tables: int) -> DataFrame:
        """(asked_as, found) of the askers that found any."""
        lookers = parts(askers.select(F.col("asked_as").alias("vec_id"), "x").mapInArrow(
            buckets(width, probes, tables), "vec_id long, x array<double>, bucket long"), LOOKERS, "q")
        q_parts = lookers.groupBy("bucket").agg((F.max("q_part") + 1).alias("n"))
        wide = lookers.join(F.broadcast(c_parts), "bucket").withColumn("c_part", every).drop("n")
        deep = members.join(F.broadcast(q_parts), "bucket").withColumn("q_part", every).drop("n")
        pairs = wide.join(deep, ["bucket", "q_part", "c_part"]).select("q_ids", "q", "c_ids", "c")
        found = pairs.mapInArrow(rerank(k + 1), "query_id long, vec_id long, score double")
        return cut(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
            "place", F.row_number().over(ranked)).where(F.col("place") <= k + 1).groupBy("query_id").agg(
            F.collect_list(F.struct("place", "vec_id", "score")).alias("found")).withColumnRenamed("query_id", "asked_as"))

    # Queries left short look into ever more buckets; in the end into all of one table, where every row is.
    enough = min(k + 1, index.count())
    askers, found = first, None
    while True:
        every_one = probes >= 2 * width
        new = search(askers, probes, 1 if every_one and found is not None else TABLES)
        full = new.where(F.size("found") >= enough)
        short = cut(askers.join(full, "asked_as", "left_anti"))
        done = new if every_one else full
        found = done if found is None else found.unionByName(done)
        if every_one or short.isEmpty():
            break
        askers, probes = short, min(4 * probes, 2 * width)
    answers = asking.select(F.col("vec_id").alias("query_id"), "x").join(first, "x").select("query_id", "asked_as").join(
        found, "asked_as")
    kept = F.slice(F.filter(F.array_sort("found"), lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(kept).alias("place", "f")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op8_ann(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest found of every query row, as its contract names them.

    Rows without an id, without a vector, with a null or non-finite component or with none
    but zeros take no part; rows that repeat an id count once (see
    ``vectors.usable``); other columns are not read.
    """
    rows = usable(embeddings).where(F.exists("x", lambda v: v != 0))
    return nearest(rows, is_query(F.col("vec_id")))
