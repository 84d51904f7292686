"""Searches against brute force; odd rows; recall."""

import math

import numpy as np
import pytest

from cargolens.llm import ann, topk
from cargolens.llm.vectors import best

SCHEMA = "vec_id long, embedding array<float>, x string, score double"


def usable(rows):
    """id -> vector of the rows that take part."""
    kept = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e):
            v = [float(np.float32(c)) for c in e]
            kept[i] = min(kept.get(i, v), v)
    return kept


def plain(vectors, measure, k=20):
    out = []
    for q, a in vectors.items():
        if q % 20 == 0:
            found = sorted((-measure(a, b), c) for c, b in vectors.items() if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def whole(a, b):
    n = max(len(a), len(b))
    a, b = ([math.floor(64 * c) for c in v] + [0] * (n - len(v)) for v in (a, b))
    return sum(x * y for x, y in zip(a, b))


def inner(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def random_rows(n, width, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), "a", 0.5) for i, v in enumerate(x)]


ODD = [(20, None, "a", 1.0), (None, [1.0, 0.0], "a", 1.0), (40, [1.0, None], "a", 1.0), (60, [float("nan"), 0.0], "a", 1.0),
       (80, [float("inf"), 0.0], "a", 1.0), (100, [0.5, 0.25], "a", None), (100, [0.5, 0.25], "a", None), (101, [0.5, 0.25], None, 1.0),
       (102, [0.5, 0.25], "b", 1.0), (120, [-0.5, 0.25], "b", 1.0), (7, [0.5], "b", 1.0), (8, [3.0, -2.0], "b", 1.0),
       (8, [-3.0, 2.0], "b", 1.0)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "BINS", 8)
    rows = random_rows(230, 6) + [(1000 + i, [0.5] * 6, "same", 0.0) for i in range(70)]
    got = rows_of(topk.op5_topk(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(usable(rows), whole)


def test_top_k_odd_rows(spark):
    got = topk.op5_topk(spark.createDataFrame(ODD, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows_of(got) == plain(usable(ODD), whole)
    assert topk.op5_topk(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.op5_topk(spark.createDataFrame([(20, [1.0], "a", 0.0)], SCHEMA)).count() == 0


def test_large_integers_stay_exact():
    q, c = np.array([[2**27, 3]]), np.array([[2**27, 5], [-(2**27), 7]])
    assert topk.product(q, c).tolist() == [[2**54 + 15, -(2**54) + 21]]


def test_best_breaks_ties_by_id():
    row, score, ids = np.array([0, 0, 0, 1, 1]), np.array([2, 3, 3, 1, 1]), np.array([1, 9, 4, 8, 2])
    assert best(row, score, ids, 2).tolist() == [2, 1, 4, 3]


def test_nearest_odd_rows(spark):
    rows = ODD + [(140, [0.0, 0.0], "z", 1.0), (160, [], "z", 1.0)]
    vectors = {i: v for i, v in usable(rows).items() if any(v)}
    got = ann.op8_ann(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows_of(got) == plain(vectors, inner)
    assert ann.op8_ann(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors(spark, monkeypatch):
    """A vector that a third of the rows share: ties go to the smallest ids, wherever they lie."""
    monkeypatch.setattr(ann, "MEMBERS", 16)
    monkeypatch.setattr(ann, "LOOKERS", 4)
    rows = random_rows(120, 8) + [(1000 + i, [0.25] * 8, "same", 0.0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole_index = ann.nearest(ann.usable(df), ann.is_query(ann.F.col("vec_id")), probes=16)
    assert rows_of(whole_index) == plain(usable(rows), inner)


def recall(got, rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    hit = total = 0
    by = {}
    for q, _, c, _ in got:
        by.setdefault(q, set()).add(c)
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:k]]
        hit, total = hit + len(by.get(q, set()) & set(top.tolist())), total + len(top)
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(rows_of(ann.op8_ann(df)), rows) >= 0.9


def test_recall_random(spark):
    rows = random_rows(4000, 48, seed=9)
    assert recall(rows_of(ann.op8_ann(spark.createDataFrame(rows, SCHEMA))), rows) >= 0.9


def test_rotation_keeps_lengths_and_axes_find_themselves():
    x = ann.unit(np.random.default_rng(1).normal(size=(50, 13)))
    r = ann.rotate(x, 2)
    assert r.shape == (50, 16) and np.allclose(np.linalg.norm(r, axis=1), 1)
    assert (ann.axes(x, 3)[:, 0] == ann.axes(x, 3, 5)[:, 0]).all()


def test_every_query_gets_its_k(spark):
    """Isolated vectors, whose own buckets hold next to nothing, beside clusters; one probe, as the fit gives it there."""
    rnd = np.random.default_rng(12)
    centres = ann.unit(rnd.normal(size=(3, 32)))
    x = centres[rnd.integers(3, size=1200)] + 0.02 * rnd.normal(size=(1200, 32))
    x[::20][:12] = rnd.normal(size=(12, 32))
    rows = [(i, v.tolist(), "a", 0.5) for i, v in enumerate(ann.unit(x))]
    df = ann.usable(spark.createDataFrame(rows, SCHEMA))
    got = rows_of(ann.nearest(df, ann.is_query(ann.F.col("vec_id")), probes=1))
    count = {}
    for q, *_ in got:
        count[q] = count.get(q, 0) + 1
    assert count == {q: 20 for q in range(0, 1200, 20)}


def test_recall_of_unequal_lengths(spark):
    """Largest inner products, not angles, with lengths that differ widely."""
    lengths = np.random.default_rng(14).lognormal(0, 1, 4000)
    rows = [(i, (np.array(v) * m).astype(np.float32).tolist(), a, b) for (i, v, a, b), m in zip(random_rows(4000, 48, seed=9), lengths)]
    assert recall(rows_of(ann.op8_ann(spark.createDataFrame(rows, SCHEMA))), rows) >= 0.9
