"""Hard-negative mining by integer matrix products in a residue number system.

Scores are inner products of integer vectors. A task multiplies the vectors' residues
modulo several small primes as float32 matrices, in slices of the components so short that every sum
stays below 2^24 and is therefore exact; the primes are as many as the largest possible score
asks for, and mixed-radix digits (Chinese remaindering) give the signed score back. A first pass takes each
anchor's nearest rows of its own label as positives, meeting only blocks of that label; a second one
selects, for each positive, the best rows of other labels in a window below the positive's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, matrix, same_width

SCALE = 256
ANCHOR_MODULUS = 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these tenths of the positive's score.
LOW_TENTHS, HIGH_TENTHS = 3, 9
#: Vectors in a block at most, and components in a block of candidates: wide vectors come in smaller blocks.
ANCHOR_BLOCK, CANDIDATE_BLOCK, COMPONENTS = 512, 2048, 2**17
#: Sums of float32 integers are exact up to here.
EXACT = 2**24
#: Components multiplied in one float32 product.
TERMS = 64


def primes(bound: int, terms: int = TERMS) -> list[int]:
    """Primes, largest first, whose product exceeds 2 * bound + 1 and whose centred residues keep ``terms`` products exact."""
    limit = 2 * math.isqrt(EXACT // terms) + 1
    sieve = np.ones(limit + 1, dtype=bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(limit) + 1):
        if sieve[i]:
            sieve[i * i::i] = False
    out, reach = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if reach > 2 * bound + 1:
            break
        out.append(p)
        reach *= p
    return out


def residue_product(a: np.ndarray, b: np.ndarray, p: int, terms: int = TERMS) -> np.ndarray:
    """a @ b.T modulo p (0 to p - 1), of integer matrices, as float32 products of centred residues."""
    a, b = ((r := np.mod(x, p)) - p * (r > p // 2) for x in (a, b))
    a, b = a.astype(np.float32), b.astype(np.float32)
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(0, a.shape[1], terms):
        total += (a[:, i:i + terms] @ b[:, i:i + terms].T).astype(np.int64)
    return total % p


def product(a: np.ndarray, b: np.ndarray, moduli: list[int], bound: int) -> np.ndarray:
    """Exact inner products of the rows, each at most ``bound`` in size (beyond 64 bits: modulo 2^64)."""
    a, b = same_width(a, b)
    # The score plus the bound is a number from 0 to 2 * bound, which its residues determine.
    digits: list[np.ndarray] = []
    value, weight = np.zeros((len(a), len(b)), dtype=np.uint64), 1
    for i, p in enumerate(moduli):
        digit = (residue_product(a, b, p) + bound) % p if bound < 2**62 else (residue_product(a, b, p) + bound % p) % p
        for q, d in zip(moduli[:i], digits):
            digit = (digit - d) * pow(q, -1, p) % p
        digits.append(digit)
        value += digit.astype(np.uint64) * np.uint64(weight % 2**64)
        weight *= p
    return (value - np.uint64(bound % 2**64)).view(np.int64)


def prepared(rows: DataFrame, corrupted: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x array<long>) of ``embeddings``: floor(scale * component), as 64-bit integers.

    Rows without an id or label, without a vector or with a null or non-finite component take no part. An
    id that repeats counts once, with its smallest vector and then label. ``corrupted`` is a condition on vec_id under
    which the label becomes (label + 1) % 10: noise to mine against.
    """
    def finite(v: Column) -> Column:
        return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))

    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("x"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    good = good.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r")).select("vec_id", "r.label", "r.x")
    if corrupted is not None:
        good = good.withColumn("label", F.when(corrupted, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return good.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long")))


def blocks(rows: DataFrame, by: list[str], size: int, name: str, columns: list[str]) -> DataFrame:
    """``by``, number of the block, how many blocks its group has, and the block's rows as arrays, about ``size`` of them."""
    if by:
        # Both sides of this join are files, so that a group with a large share of the rows is split.
        n = cut(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias(f"{name}_blocks")))
        rows = rows.join(n, by)
    else:
        rows = rows.withColumn(f"{name}_blocks", F.lit(max(1, -(-rows.count() // size))))
    block = F.pmod(F.xxhash64("vec_id"), F.col(f"{name}_blocks")).alias(f"{name}_block")
    grouped = rows.select(*by, f"{name}_blocks", block, F.struct(*columns).alias("r")).groupBy(*by, f"{name}_block", f"{name}_blocks")
    return cut(grouped.agg(F.collect_list("r").alias("r")).select(
        *by, f"{name}_block", F.col(f"{name}_blocks").cast("long").alias(f"{name}_blocks"), *[F.col(f"r.{c}").alias(f"{name}_{c}") for c in columns]))


def tiles(anchors: DataFrame, candidates: DataFrame, by: list[str], anchor_columns: list[str], candidate_columns: list[str], width: int) -> DataFrame:
    """Every block of anchors with every block of candidates of the same group, each pair on its own key."""
    most = max(1, COMPONENTS // max(1, width))
    a = blocks(anchors, by, min(ANCHOR_BLOCK, most), "a", anchor_columns)
    c = blocks(candidates, by, min(CANDIDATE_BLOCK, most), "c", candidate_columns)

    def met(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        numbers = other.groupBy(*by).agg(F.max(f"{name}_blocks").alias("n")) if by else other.agg(F.max(f"{name}_blocks").alias("n"))
        own = own.join(numbers, by) if by else own.crossJoin(F.broadcast(numbers))  # one row
        return own.withColumn(f"{name}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")

    columns = [f"a_{c}" for c in anchor_columns] + [f"c_{c}" for c in candidate_columns]
    return met(a, c, "c").join(met(c, a, "a"), [*by, "a_block", "c_block"]).select(*columns)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].values for name in batch.schema.names}


def nearest(moduli: list[int], bound: int, k: int):
    """Of each tile of one label: the anchors' k best candidates, without themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            a_ids, c_ids = r["a_vec_id"].to_numpy(), r["c_vec_id"].to_numpy()
            row, at, s = highest(product(matrix(r["a_x"]), matrix(r["c_x"]), moduli, bound), a_ids[:, None] != c_ids[None, :], c_ids, k)
            yield pa.record_batch({"anchor_id": a_ids[row], "positive_id": c_ids[at], "positive_score": s})
    return run


def highest(scores: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and scores of the k highest scores of each row among those that count, ties to smaller ids."""
    if scores.shape[1] > k:
        least = np.iinfo(np.int64).min
        kth = np.partition(np.where(counts, scores, least), -k, axis=1)[:, -k]
        counts = counts & (scores >= kth[:, None])
    row, at = np.nonzero(counts)
    top = best(row, scores[row, at], ids[at], k)
    row, at = row[top], at[top]
    return row, at, scores[row, at]


def in_windows(moduli: list[int], bound: int, k: int):
    """Of each tile: for every positive of an anchor, the k best candidates of other labels in the positive's window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            a_ids, c_ids = r["a_vec_id"].to_numpy(), r["c_vec_id"].to_numpy()
            scores = product(matrix(r["a_x"]), matrix(r["c_x"]), moduli, bound)
            other = r["a_label"].to_numpy()[:, None] != r["c_label"].to_numpy()[None, :]
            # An anchor's missing positives have an empty window.
            n = np.diff(r["a_positives"].offsets.to_numpy())
            windows = r["a_positives"].flatten()
            first = np.cumsum(n) - n
            positive, score = (windows.field(c).to_numpy() for c in ("positive_id", "positive_score"))
            # Tenths of a score without overflow.
            low = score // 10 * LOW_TENTHS - (-(score % 10) * LOW_TENTHS) // 10
            high = score // 10 * HIGH_TENTHS + (score % 10) * HIGH_TENTHS // 10
            for j in range(n.max(initial=0)):
                have = np.flatnonzero(n > j)
                w = first[have] + j
                s = scores[have]
                row, at, s = highest(s, other[have] & (s >= low[w][:, None]) & (s <= high[w][:, None]), c_ids, k)
                yield pa.record_batch({"anchor_id": a_ids[have[row]], "positive_id": positive[w[row]], "positive_score": score[w[row]],
                                       "negative_id": c_ids[at], "negative_score": s})
    return run


def first_by(rows: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The k highest scores of each key, numbered from 1; every task sends k rows of a key at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows``: (vec_id long, label long, x array<long>)
    with different ids.

    A shorter vector counts as filled up with zeros. Scores beyond 64 bits count modulo 2^64. An anchor without another row of
    its label, and a positive without a row in its window (any of a negative score), give no rows; no rows give an empty frame.
    """
    rows = cut(rows)
    # |score| is at most the largest squared length (Cauchy-Schwarz); a little is added for the rounding of doubles.
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    largest, width = rows.agg(F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    bound = int(largest * (1 + 1e-9)) + 1
    moduli, anchors = primes(bound), rows.where(is_anchor)
    near = tiles(anchors, rows, ["label"], ["vec_id", "x"], ["vec_id", "x"], width).mapInArrow(
        nearest(moduli, bound, positives), "anchor_id long, positive_id long, positive_score long")
    near = first_by(near, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = tiles(anchors.join(cut(windows), "vec_id"), rows, [], ["vec_id", "label", "x", "positives"], ["vec_id", "label", "x"], width).mapInArrow(
        in_windows(moduli, bound, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return first_by(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, as its contract names them; see ``prepared``
    for odd rows and ``mine`` for empty results. Other columns are not read."""
    vec_id = F.col("vec_id")
    return mine(prepared(embeddings, vec_id % 7 == 0), vec_id % ANCHOR_MODULUS == 0)


ORACLE = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id
    WHERE a.vec_id % {ANCHOR_MODULUS} = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= {NEGATIVES}
"""
