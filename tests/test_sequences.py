"""Ordered work per key: against plain loops, with keys cut into slices and with none cut, and a third of all rows on one key."""

import contextlib
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cargolens.catalog import QUERIES
from cargolens.functions import sequences

T0 = dt.datetime(2020, 1, 1)
SLICED = [25, 10**6]  # rows in a slice: many slices, and no key cut


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def rows(n, seed, span_days=200):
    """(key, time, id, value): a third of the rows on key 'hot'; times repeat; some keys and times are null."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        at = None if rnd.random() < 0.02 else T0 + dt.timedelta(hours=rnd.randrange(span_days * 24 // 6) * 6)
        out.append((key, at, i, Decimal(rnd.randrange(-500, 900)) / 100))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t timestamp_ntz, id long, v decimal(12,2)").repartition(5)


@pytest.mark.parametrize("most", SLICED)
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, most, inclusive):
    left, right = rows(300, 1), [(k, t, i, v) for k, t, i, v in rows(150, 2) if i % 7]
    # The hot key has right rows only at the start, so later slices get theirs handed on.
    right = [r for r in right if r[0] != "hot" or (r[1] and r[1] < T0 + dt.timedelta(days=20))]
    got = sequences.asof_join(frame(spark, left).withColumnRenamed("id", "l"), frame(spark, right).select("k", F.col("t").alias("since"), "id", F.col("v").alias("w")),
                              ["k"], "t", ["id", "w"], right_time="since", tie=["id"], inclusive=inclusive, most=most)
    assert got.columns == ["k", "t", "l", "v", "id", "w"]
    want = []
    for k, t, i, v in left:
        fit = [] if k is None or t is None else [r for r in right if r[0] == k and r[1] is not None and (r[1] <= t if inclusive else r[1] < t)]
        best = max(fit, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((k, t, i, v, best[2], best[3]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_asof_of_a_hot_key_is_no_single_task(spark, tmp_path):
    """A third of the events on one key: no task of the sorted pass holds them all."""
    n = 30_000
    events = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 10).alias("k"), "id",
                                   F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("t"))
    states = spark.createDataFrame([(0, T0, "new"), (0, T0 + dt.timedelta(days=3), "old")], "k long, t timestamp_ntz, state string")
    joined = sequences.asof_join(events, states, ["k"], "t", ["state"], most=1000, unit="hour")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = spark.read.parquet(str(tmp_path / "out"))
    hot = out.where("k = 0")
    assert out.count() == n and {r.state: r["count"] for r in hot.groupBy("state").count().collect()} == {"new": 1440, "old": n // 3 - 1440}
    assert out.where("k > 0 and state is not null").isEmpty()
    per_file = [r["count"] for r in hot.groupBy(F.input_file_name()).count().collect()]  # a file for each task
    assert len(per_file) > 4 and max(per_file) < n // 3 // 2


def per_key(data):
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or T0, r[2])) for k, v in by.items()}


@pytest.mark.parametrize("most", SLICED)
def test_neighbours(spark, most):
    data = rows(300, 3)
    df = sequences.neighbour(frame(spark, data), ["k"], ["t", "id"], ["id"], "before", most=most)
    df = sequences.neighbour(df, ["k"], ["t", "id"], ["id", "v"], "after", ahead=True, most=most)
    want = {}
    for seq in per_key([r for r in data if r[0] is not None and r[1] is not None]).values():
        for i, r in enumerate(seq):
            want[r[2]] = (seq[i - 1][2] if i else None, seq[i + 1][2:] if i + 1 < len(seq) else None)
    got = {r.id: (r.before and r.before.id, r.after and tuple(r.after)) for r in df.where("k is not null and t is not null").collect()}
    timeless = {r[2] for r in data if r[1] is None}  # come first in slice 0
    for i, (b, a) in want.items():
        assert got[i][1] == a and (got[i][0] == b or b is None and got[i][0] in timeless | {None}), i
    assert df.count() == len(data)


@pytest.mark.parametrize("most", SLICED)
def test_running_and_trailing_totals(spark, most):
    data = [r for r in rows(300, 4) if r[0] and r[1]]
    data = [(*r[:3], None if r[2] % 11 == 0 or r[0] == "c" and r[1] < T0 + dt.timedelta(days=90) else r[3]) for r in data]
    df = sequences.running_total(frame(spark, data), ["k"], "t", F.col("v"), "upto", most=most)
    df = sequences.running_total(df, ["k"], "t", F.lit(1), "nth", most=most, order=["id"])
    df = sequences.trailing_total(df, ["k"], "t", F.col("v"), 30, "trailing", most=most)
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(data)
    for seq in per_key(data).values():
        for n, (k, t, i, v) in enumerate(seq):
            upto = [w for _, u, _, w in seq if u <= t and w is not None]
            trail = [w for _, u, _, w in seq if t - dt.timedelta(days=30) <= u <= t and w is not None]
            assert got[i].nth == n + 1 and got[i].upto == (sum(upto) if upto else None)
            assert got[i].trailing == (sum(trail) if trail else None)
    plain = frame(spark, data).selectExpr("id", "sum(v) over (partition by k order by t range between interval 30 days preceding and current row) s")
    assert {r.id: r.s for r in plain.collect()} == {i: r.trailing for i, r in got.items()}


@pytest.mark.parametrize("most", SLICED)
def test_sessions(spark, most):
    data = [r for r in rows(240, 5, 900) if r[0] and r[1]]
    got = {r.id: r.session_no for r in sequences.sessions(frame(spark, data), ["k"], ["t", "id"], 4, most=most).collect()}
    for seq in per_key(data).values():
        no = 0
        for i, r in enumerate(seq):
            no += not i or r[1] - seq[i - 1][1] > dt.timedelta(days=4)
            assert got[r[2]] == no


def test_interval_join(spark):
    """Against all pairs: minutes next to decades, empty, reversed and open intervals, one key with a third of the rows."""
    rnd = random.Random(6)

    def spans(n, seed):
        out = []
        for i in range(n):
            start = T0 + dt.timedelta(minutes=rnd.randrange(0, 400_000))
            length = rnd.choice([0, -5, 1, 30, 60, 240, 1440, 40_000, 10_000_000])
            out.append(("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), i, None if i % 41 == 0 else start, start + dt.timedelta(minutes=length)))
        return out

    left, right = spans(200, 1), spans(160, 2)
    schema = "k string, id long, s timestamp_ntz, e timestamp_ntz"
    df = sequences.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("s", "e"), ("s", "e"))
    ok = [[r for r in side if r[0] and r[2] and r[2] < r[3]] for side in (left, right)]
    want = sorted((a[1], b[1]) for a in ok[0] for b in ok[1] if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.l.id, r.r.id) for r in df.collect()) == want and want
    p = plan(df)
    assert "NestedLoop" not in p and "Cartesian" not in p


@pytest.mark.parametrize("most", SLICED)
def test_overlap_counts(spark, most):
    """Against all pairs, with a hot key all of whose intervals overlap."""
    rnd = random.Random(7)
    data = []
    for i in range(240):
        start = T0 + dt.timedelta(hours=rnd.randrange(0, 2000) // 5 * 5)
        data.append(("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), i, None if i % 37 == 0 else start, start + dt.timedelta(hours=rnd.choice([0, -3, 5, 10, 400, 5000]))))
    df = spark.createDataFrame(data, "k string, id long, s timestamp_ntz, e timestamp_ntz")
    got = {r.id: r.others for r in sequences.overlap_counts(df, ["k"], "s", "e", "others", most=most).collect()}
    ok = [r for r in data if r[0] and r[2] and r[2] < r[3]]
    want = {r[1]: 0 for r in data} | {a[1]: sum(a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3] for b in ok) for a in ok}
    assert got == want


def test_overlap_counts_lay_out_one_sequence(spark):
    """Rows that repeat count each other; starts and ends are shuffled once, and columns that nobody asks for stay behind."""
    t = [T0 + dt.timedelta(hours=h) for h in range(4)]
    data = [("a", 1, t[0], t[2], "x"), ("a", 1, t[0], t[2], "x"), ("a", 2, t[1], t[3], "x"), ("a", 3, t[2], t[3], "x"), (None, 4, t[0], t[3], "x")]
    df = sequences.overlap_counts(spark.createDataFrame(data, "k string, id long, s timestamp_ntz, e timestamp_ntz, note string"), ["k"], "s", "e", "others")
    assert sorted((r.id, r.others) for r in df.collect()) == [(1, 2), (1, 2), (2, 3), (3, 1), (4, 0)]
    p = plan(df.select("k", "others"))
    assert p.count("Exchange hashpartitioning") == 1 and "note" not in p.split("Exchange hashpartitioning")[0]


def test_empty_frames(spark):
    none = frame(spark, [])
    assert sequences.asof_join(none, none.withColumnRenamed("id", "x"), ["k"], "t", ["x"]).isEmpty()
    assert sequences.trailing_total(none, ["k"], "t", F.col("v"), 9, "s").isEmpty()
    assert sequences.interval_join(none.withColumn("e", F.col("t")), none.withColumn("e", F.col("t")), ["k"], ("t", "e"), ("t", "e")).isEmpty()


def test_queries_have_no_nested_loops(tables):
    for name in ("payment_order_state", "seller_concurrent_orders", "product_orders_at_once", "customer_trailing_revenue"):
        p = plan(QUERIES[name](tables))
        loops = [line for line in p.splitlines() if "NestedLoop" in line or "Cartesian" in line]
        assert all("n_orders" in line for line in loops), name  # the adapter's one-row order count


@pytest.mark.parametrize("name", ["payment_order_state", "customer_order_gaps", "customer_sessions", "customer_trailing_revenue", "seller_concurrent_orders"])
def test_queries_are_the_same_in_slices(tables, monkeypatch, name):
    whole = sorted(map(str, QUERIES[name](tables).collect()))
    monkeypatch.setattr(sequences.Slices.__init__, "__defaults__", (2, "day"))
    for f in (sequences.asof_join, sequences.trailing_total, sequences.sessions, sequences.overlap_counts):
        monkeypatch.setattr(f, "__defaults__", tuple(2 if d == sequences.SLICE_ROWS else d for d in f.__defaults__))
    assert sorted(map(str, QUERIES[name](tables).collect())) == whole
