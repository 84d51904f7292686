"""Exact products by residues; hard negatives against plain mining."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score double"


def plain(rows):
    kept = {}
    for i, e, label, *_ in rows:
        if i is not None and label is not None and e is not None and all(v is not None and math.isfinite(v) for v in e):
            v = ([math.floor(256 * float(np.float32(c))) for c in e], label)
            kept[i] = min(kept.get(i, v), v)
    kept = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in kept.items()}
    out = []
    for a, (x, label) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (y, other) in kept.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            fit = [(n, i) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def random_rows(n, width, labels, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + 0.7 * rng.normal(size=(labels, width))[np.arange(n) % labels]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # A third of the rows has one label.
    return [(i, v.tolist(), 0 if i % 3 == 0 else i % labels, "clash", 0.0) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("scale, width", [(3, 5), (300, 64), (300, 700), (2**31, 9)])
def test_product_is_exact(scale, width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-scale, scale + 1, size=(n, width)) for n in (7, 11))
    bound = width * scale * scale
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a], dtype=object)
    got = hard_negatives.product(a, b, hard_negatives.primes(bound), bound)
    assert got.dtype == np.int64
    assert [[int(v) % 2**64 for v in r] for r in got] == [[v % 2**64 for v in r] for r in exact.tolist()]


def test_primes_reach_the_bound_and_stay_exact():
    for bound in (1, 65_800, 10**12, 2**130):
        p = hard_negatives.primes(bound)
        assert math.prod(p) > 2 * bound + 1 and len(set(p)) == len(p)
        assert hard_negatives.TERMS * (max(p) // 2) ** 2 <= hard_negatives.EXACT


def test_mining(spark, monkeypatch):
    """Several blocks of anchors and candidates, a hot label, equal vectors at the thresholds."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 60)
    rows = random_rows(900, 6, 10) + [(2000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.5], i % 4, "same", 0.0) for i in range(120)]
    assert rows_of(hard_negatives.op12_hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_wide_vectors_come_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "COMPONENTS", 40)
    rows = random_rows(220, 9, 3)
    assert rows_of(hard_negatives.op12_hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    rows = [(100, [0.5, 0.25], 1, "a", 1.0), (100, [0.5, 0.25], 1, "a", 1.0), (100, [0.5, 0.25], 2, None, None), (200, None, 1, "a", 1.0),
            (300, [1.0, None], 1, "a", 1.0), (400, [float("nan"), 0.0], 1, "a", 1.0), (500, [float("inf"), 0.0], 1, "a", 1.0),
            (600, [0.5, 0.5], None, "a", 1.0), (None, [0.5, 0.5], 1, "a", 1.0), (700, [0.5, 0.5], 1, "a", 1.0), (0, [], 3, "a", 1.0),
            (101, [0.5], 1, "a", 1.0), (102, [0.5, 0.2], 1, "a", 1.0), (103, [0.2, 0.2], 2, "a", 1.0), (104, [0.2, 0.2], 2, "a", 1.0),
            (105, [0.1, 0.2, 0.9], 9, "a", 1.0), (-100, [-0.5, 0.1], 4, "a", 1.0), (106, [0.3, -0.1], 4, "a", 1.0), (800, [0.0, 0.0], 5, "a", 1.0),
            (801, [0.0, 0.0], 5, "a", 1.0), (802, [0.0, 0.0], 6, "a", 1.0)]
    got = rows_of(hard_negatives.op12_hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and got
    assert hard_negatives.op12_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.op12_hard_negatives(spark.createDataFrame([(100, [1.0], 1, "", 0.0)], SCHEMA)).count() == 0


def test_large_components(spark):
    """Scores beyond float32 and float64 stay exact."""
    rows = [(i, [float(2**17 * (i % 13 + 1) + i), float(3 * i - 40)], i % 2, "", 0.0) for i in range(60)]
    doubled = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.transform("embedding", lambda v: v * 4))
    wide = [(i, [c * 4 for c in map(float, map(np.float32, e))], label, *rest) for i, e, label, *rest in rows]
    got = rows_of(hard_negatives.op12_hard_negatives(doubled))
    assert got == plain(wide) and max(r[5] for r in got) > 2**53
