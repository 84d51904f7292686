"""Statistics operators against brute-force numpy/pandas on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cargolens.functions import stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "k": np.arange(n),
        "x": rng.integers(0, 40, n).astype(float),       # heavy ties
        "y": rng.normal(0, 1, n).round(2),
        "g": np.where(rng.random(n) < 0.3, "a", "b"),
    })
    pdf.loc[::97, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))


@pytest.mark.parametrize("steps", [4096, 3, 1])
def test_average_ranks_match_pandas(spark, sample, monkeypatch, steps):
    pdf, df = sample
    monkeypatch.setattr(stats, "BUCKET_STEPS", steps)
    r = stats.average_ranks(stats.value_counts(df, "x")).toPandas().set_index("v")["rank"]
    expect = pdf["x"].rank(method="average")
    got = pdf["x"].map(r)
    assert np.allclose(got.values, expect.values)


def test_spearman_matches_pandas(spark, sample):
    pdf, df = sample
    got = stats.spearman_raw(df, "k", [("x", "y")]).first()
    d = pdf.dropna()
    expect = d["x"].rank().corr(d["y"].rank())
    assert got["n"] == len(d)
    assert got["rho"] == pytest.approx(expect, abs=1e-12)
    t = expect * math.sqrt((len(d) - 2) / (1 - expect ** 2))
    p = stats.spearman_test(stats.spearman_raw(df, "k", [("x", "y")])).first()["p_value"]
    assert p == pytest.approx(t_tail(t, len(d) - 2), abs=2e-9)


def t_tail(t, df):
    """Two-sided p of Student's t from its angle: the integral of cos^(df-1), by Simpson's rule."""
    def integral(a, b, n=200_000):
        x = np.linspace(a, b, n + 1)
        y = np.exp((df - 1) * np.log(np.maximum(np.cos(x), 1e-300)))
        return (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3

    return integral(math.atan(abs(t) / math.sqrt(df)), math.pi / 2) / integral(0, math.pi / 2)


def tails(spark, rows):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "t double, df double")
    return [r[0] for r in d.select(stats.t_two_sided_p(F.col("t"), F.col("df"))).collect()]


def test_t_tail_small_and_middle_df(spark):
    # df 1 and 2 have closed forms; the others come from the angle integral.
    p = tails(spark, [(1.0, 1), (1e6, 1), (0.0, 5), (3.0, 2), (2.0, 10), (3.5, 200), (-1.3, 37)])
    closed = [0.5, 2 / math.pi * math.atan(1e-6), 1.0, 1 - 3 / math.sqrt(2 + 9)]
    assert p[:4] == pytest.approx(closed, rel=1e-9)
    assert p[4:] == pytest.approx([t_tail(2.0, 10), t_tail(3.5, 200), t_tail(1.3, 37)], rel=1e-9)


@pytest.mark.parametrize("df", [1e8, 1e9, 1e10, 1e11, 1e12])
def test_t_tail_large_df(spark, df):
    ts = [0.001, 0.5, 2.0, 6.0]
    # normal tail with the first correction in 1 / df
    want = [math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / (2 * df) for t in ts]
    assert tails(spark, [(t, df) for t in ts]) == pytest.approx(want, rel=1e-9)


def test_normal_tail(spark):
    d = spark.createDataFrame([(z,) for z in (-3.0, 0.0, 1.959963985, 9.0)], "z double")
    got = [r[0] for r in d.select(stats.normal_sf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in (-3.0, 0.0, 1.959963985, 9.0)], rel=1e-9)


def test_perfect_correlation_has_p_zero(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1, -3.0 * i) for i in range(30)], "k long, x double, y double, z double")
    rows = stats.spearman_test(stats.spearman_raw(df, "k", [("x", "y"), ("x", "z")])).collect()
    assert [(r["rho"], r["p_value"], r["stars"]) for r in rows] == [(1.0, 0.0, "***"), (-1.0, 0.0, "***")]
    g = stats.ols_test(stats.ols_raw(df, "x", "y")).first()
    assert g["p_value"] == 0.0 and g["significant"]


def test_ranks_hold_where_one_value_has_most_rows(spark):
    """Ties are counted, not listed: most rows share one value, whatever its number."""
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).cast("double").alias("x"),
                               (F.col("id") % 3).cast("double").alias("y"))
    pdf = df.toPandas()
    got = stats.spearman_raw(df, "k", [("x", "y")]).first()["rho"]
    assert got == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-12)


def test_empty_and_short_frames(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "k long, x double, y double")
    assert stats.spearman(df, "k", [("x", "y")]).first()["n"] == 0
    q = stats.quantiles(df, "y", [0.5], ["m"]).first()
    assert q["m"] is None and stats.quantiles(df, "x", [0.1, 0.9], ["a", "b"]).first()[:] == (2.0, 2.0)
    assert stats.histogram(df, "y", 5).count() == 0
    h = stats.histogram(df, "x", 5).collect()
    assert [r["count"] for r in h] == [1, 0, 0, 0, 0]


def test_mann_whitney_without_a_test(spark):
    schema = "x double, g string"
    for rows in ([(1.0, "a"), (2.0, "a")], [(1.0, "a")], [(3.0, "a"), (3.0, "b"), (3.0, "b")], []):
        m = stats.mann_whitney_test(stats.mann_whitney(spark.createDataFrame(rows, schema), "x", F.col("g"), "a")).first()
        assert m["z"] is None and m["p_value"] is None
        assert m["n1"] + m["n2"] == len(rows)


def test_mann_whitney_matches_pair_counting(spark, sample):
    pdf, df = sample
    m = stats.mann_whitney(df, "x", F.col("g"), "a").first()
    a = pdf.loc[pdf.g == "a", "x"].values
    b = pdf.loc[pdf.g == "b", "x"].values
    u1 = sum(((ai > b).sum() + 0.5 * (ai == b).sum()) for ai in a)
    assert m["n1"] == len(a) and m["n2"] == len(b)
    assert m["u_statistic"] == pytest.approx(u1)
    n = len(a) + len(b)
    counts = pdf["x"].value_counts().values.astype(float)
    sigma = math.sqrt(len(a) * len(b) / 12 * ((n + 1) - (counts ** 3 - counts).sum() / (n * (n - 1))))
    z = (len(a) * len(b) - u1 - len(a) * len(b) / 2 - 0.5) / sigma
    assert m["z"] == pytest.approx(z, rel=1e-9)
    p = stats.mann_whitney_test(stats.mann_whitney(df, "x", F.col("g"), "a")).first()["p_value"]
    assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("steps", [1, 4096])
def test_exact_quantiles_match_numpy(spark, sample, monkeypatch, steps):
    pdf, df = sample
    monkeypatch.setattr(stats, "BUCKET_STEPS", steps)
    probs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = stats.quantiles(df, "y", probs, [f"q{i}" for i in range(len(probs))]).first()
    expect = np.percentile(pdf["y"].dropna().values, [p * 100 for p in probs])
    for i, e in enumerate(expect):
        assert got[f"q{i}"] == pytest.approx(e, abs=1e-12)


def test_histogram_covers_all_rows(spark, sample):
    pdf, df = sample
    h = stats.histogram(df, "y", 50).toPandas()
    assert h["count"].sum() == pdf["y"].notna().sum()
    assert h["bin"].max() == 49
    assert len(h) == 50
    counts, _ = np.histogram(pdf["y"].dropna().values, bins=50)
    assert h["count"].sum() == counts.sum()


def test_ols_matches_polyfit(spark):
    x = np.arange(20, dtype=float)
    y = 3.0 + 0.5 * x + np.sin(x)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    g = stats.ols_raw(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    r = np.corrcoef(x, y)[0, 1]
    assert g["slope"] == pytest.approx(slope) and g["intercept"] == pytest.approx(intercept)
    assert g["r_squared"] == pytest.approx(r * r)
    p = stats.ols_test(stats.ols_raw(df, "x", "y")).first()["p_value"]
    t = r * math.sqrt(18 / (1 - r * r))
    assert p == pytest.approx(t_tail(t, 18), abs=2e-9)


def test_approx_quantiles_switch(spark, sample):
    pdf, df = sample
    got = stats.quantiles(df, "y", [0.5, 0.9], ["m", "p"], exact=False, accuracy=10000).first()
    ys = np.sort(pdf["y"].dropna().values)
    # percentile_approx returns an element of the column within rank error n/accuracy
    for name, p in (("m", 0.5), ("p", 0.9)):
        rank = np.searchsorted(ys, got[name], side="right")
        assert abs(rank / len(ys) - p) <= 0.01 + 1 / len(ys)
