"""Statistics as DataFrame jobs: OLS, Spearman, Mann-Whitney U, quantiles, histograms.

Everything is a lazy plan of built-in expressions: no action runs while a query
is built, nothing but one-row frames is crossed in, and no size switches the method.

Ranking works on the frame of *distinct values with their multiplicity*, so
ties collapse before anything is sorted and a value held by a third of the
rows is one row. A value's bucket is a monotone function of the value alone
(:func:`bucket`): equal relative steps, whatever the data. Inside a bucket a
window adds up the counts; buckets get their offsets from their totals, one
row each.

p-values integrate the densities themselves (:func:`tail_ratio`), with the
normalising constant from the same rule, so they need no gamma function and
hold at any number of degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import rnd

# Buckets per factor of e in 1 + |value|.
BUCKET_STEPS = 4096


# ----------------------------------------------------------------- tails --

def _quadrature(step: float = 0.05, reach: float = 4.3) -> list[tuple[float, float]]:
    """(x, weight) of the exp-sinh rule for integrals over (0, inf). Node k is
    exp(pi/2 sinh(k * step)); densities with power or exponential tails converge
    to double precision."""
    n = int(reach / step)
    nodes = []
    for k in range(-n, n + 1):
        x = math.exp(math.pi / 2 * math.sinh(k * step))
        nodes.append((x, step * math.pi / 2 * math.cosh(k * step) * x))
    return nodes


def tail_ratio(t: Column, density: Callable[[Column], Column]) -> Column:
    """Integral of ``density`` over (t, inf) divided by that over (0, inf), t >= 0."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _quadrature()])

    def integral(start: Column) -> Column:
        return F.aggregate(nodes, F.lit(0.0), lambda acc, n: acc + n["w"] * density(start + n["x"]))

    return integral(t) / integral(F.lit(0.0))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t; NULL for NULL and without degrees of freedom."""
    nu = df.cast("double")
    p = tail_ratio(F.abs(t), lambda x: F.exp(-(nu + 1) / 2 * F.log1p(x * x / nu)))
    return F.when(t.isNotNull() & (nu > 0), p)


def normal_sf(z: Column) -> Column:
    """P(Z >= z) of the standard normal distribution."""
    half = tail_ratio(F.abs(z), lambda x: F.exp(-x * x / 2)) / 2
    return F.when(z >= 0, half).when(z < 0, 1 - half)


def correlation_p(r: Column, n: Column, t: Column) -> Column:
    """Two-sided p of a correlation: t with n - 2 degrees of freedom; 0 at r = 1 or -1."""
    return F.when((F.abs(r) >= 1) & (n > 2), F.lit(0.0)).otherwise(t_two_sided_p(t, n - 2))


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


# -------------------------------------------------------------------- OLS --

def ols_raw(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r, r^2 and t of y on x (one row, unrounded)."""
    r2 = F.regr_r2(F.col(y), F.col(x))
    g = df.agg(F.count(F.col(y)).alias("n"),
               F.regr_slope(F.col(y), F.col(x)).alias("slope"),
               F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
               r2.alias("r_squared"))
    r = F.signum("slope") * F.sqrt("r_squared")
    return g.withColumn("r", r).withColumn(
        "t_stat", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1.0 - F.col("r") ** 2)))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    g = ols_raw(df, x, y)
    return g.select("n", rnd("slope", 6).alias("slope"), rnd("intercept", 6).alias("intercept"),
                    rnd("r_squared", 6).alias("r_squared"), rnd("t_stat", 6).alias("t_stat"))


def ols_test(raw: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The slope's two-sided p-value from an unrounded :func:`ols_raw` row."""
    g = raw.withColumn("p", correlation_p(F.col("r"), F.col("n"), F.col("t_stat")))
    return g.select("n", rnd("slope", 6).alias("slope"), rnd("r_squared", 6).alias("r_squared"),
                    rnd("p", 9).alias("p_value"), (F.col("p") < alpha).alias("significant"))


# ------------------------------------------------------------------ ranks --

def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Distinct non-NULL values of ``c`` with multiplicity (combines map-side)."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
        F.count(F.lit(1)).alias("cnt"))


def bucket(v: Column) -> Column:
    """Monotone bucket number of a value; NaN, which sorts last, goes to the last one."""
    d = v.cast("double")
    return F.when(F.isnan(d), F.lit(2**63 - 1)).otherwise(
        F.floor(F.signum(d) * F.log1p(F.abs(d)) * BUCKET_STEPS)).cast("long")


def bucket_offsets(vc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bkt, total, offset): rows of each occupied bucket, and rows before it."""
    t = vc.groupBy(*by, bucket(F.col("v")).alias("bkt")).agg(F.sum("cnt").alias("total"))
    # One row per occupied bucket: the whole range of doubles has six million.
    before = Window.partitionBy(*by).orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))


def _before(by: Sequence[str] = ()) -> Column:
    w = Window.partitionBy(*by, "bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("cnt").over(w), F.lit(0))


def average_ranks(vc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, v, cnt, ...) -> the same with ``rank``: mid-ranks 1..N within ``by``,
    ties averaged. Extra columns of ``vc`` are carried through."""
    mid = (F.col("cnt").cast("double") + 1.0) / 2.0
    ranked = vc.withColumn("bkt", bucket(F.col("v"))).withColumn("before", _before(by))
    return ranked.join(bucket_offsets(vc, by).drop("total"), [*by, "bkt"]).select(
        *vc.columns, ((F.col("offset") + F.col("before")).cast("double") + mid).alias("rank"))


def rank_products(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row: n and the sums ``s_i_j`` of products of the ranks of columns i <= j,
    over the rows without a NULL in any of ``cols``.

    Every column is ranked once, all in one job: the frame is laid out as
    (key, column, value) rows, which meet the ranks of their distinct values and
    come together again by ``key`` (unique). The join with the ranks
    stands between plain shuffles, so adaptive execution splits a value that
    most rows hold.
    """
    long = df.dropna(subset=list(cols)).select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x")
    ).select(key, "x.c", "x.v")
    ranks = average_ranks(long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt")), ["c"])
    wide = long.join(ranks.select("c", "v", "rank"), ["c", "v"]).groupBy(key).agg(
        *[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(cols))])
    return wide.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s_{i}_{j}")
        for i in range(len(cols)) for j in range(i, len(cols))])


def spearman_raw(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per (x, y): n, rho, t, unrounded. Rows with a NULL in any column of
    any pair are left out (the notebook's dropna); ``key`` is unique."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))

    def total(a: str, b: str) -> Column:
        i, j = sorted((cols.index(a), cols.index(b)))
        return F.col(f"s_{i}_{j}")

    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), total(x, y).alias("sxy"),
                              total(x, x).alias("sxx"), total(y, y).alias("syy")) for x, y in pairs])
    g = rank_products(df, key, cols).select("n", F.explode(rows).alias("p")).select("n", "p.*")
    n = F.col("n").cast("double")
    c = n * (n + 1.0) * (n + 1.0) / 4.0  # n * mean_rank^2: sum of mid-ranks is n(n+1)/2
    rho = F.try_divide(F.col("sxy") - c, F.sqrt((F.col("sxx") - c) * (F.col("syy") - c)))
    return g.select("x", "y", "n", rho.alias("rho")).withColumn(
        "t_stat", F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1.0 - F.col("rho") ** 2)))


def _shown(raw: DataFrame) -> list[Column]:
    return [*(F.col(c) for c in ("x", "y", "n")), rnd("rho", 6).alias("rho"), rnd("t_stat", 6).alias("t_stat")]


def spearman(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per (x, y): n, rho, t (rounded to 6 places)."""
    raw = spearman_raw(df, key, pairs)
    return raw.select(*_shown(raw))


def spearman_test(raw: DataFrame) -> DataFrame:
    """The two-sided p-value (t with n-2 df, as scipy's spearmanr) of unrounded
    :func:`spearman_raw` rows."""
    raw = raw.withColumn("p", correlation_p(F.col("rho"), F.col("n"), F.col("t_stat")))
    return raw.select(*_shown(raw), rnd("p", 9).alias("p_value"), stars(F.col("p")).alias("stars"))


# ----------------------------------------------------------- Mann-Whitney --

def mann_whitney(df: DataFrame, value: str, group: Column, first_label: str) -> DataFrame:
    """U test of ``value`` between group == first_label (x) and the rest (y).

    Returns n1, n2, U1 (statistic for x, as scipy reports it) and z for the
    alternative 'x is stochastically less' with continuity correction. z is NULL
    where the test says nothing: one group empty, or all values tied.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), group.alias("g"))
    # One aggregate gives both the multiplicity (for the ranks) and the
    # sample-x count per value; the ranking carries n_x through, no join.
    vc = d.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"),
                            F.count_if(F.col("g") == first_label).alias("n_x"))
    j = average_ranks(vc)
    cnt = F.col("cnt").cast("double")
    zero = F.lit(0)
    g = j.agg(F.coalesce(F.sum("n_x"), zero).alias("n1"),
              F.coalesce(F.sum("cnt") - F.sum("n_x"), zero).alias("n2"),
              F.coalesce(F.sum(F.col("n_x").cast("double") * F.col("rank")), F.lit(0.0)).alias("r1"),
              F.coalesce(F.sum(cnt * cnt * cnt - cnt), F.lit(0.0)).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1.0) / 2.0
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1.0) - F.try_divide(F.col("tie_term"), n * (n - 1.0)))
    u2 = n1 * n2 - u1
    z = F.try_divide(u2 - n1 * n2 / 2.0 - 0.5, F.when(variance > 0, F.sqrt(variance)))
    return g.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    u1.alias("u_statistic"), z.alias("z"))


def mann_whitney_test(m: DataFrame) -> DataFrame:
    """One-sided p-value of an unrounded :func:`mann_whitney` row."""
    return m.withColumn("p_value", normal_sf(F.col("z")))


# -------------------------------------------------------------- histogram --

def histogram(df: DataFrame, c: str, bins: int, label: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (matplotlib hist); every
    bin is a row, empty ones too. No values: no rows.

    Bin of x: floor((x - min) * bins / (max - min)), clamped to bins - 1.
    The min/max are a one-row aggregate crossed in (broadcast of one row).
    """
    d = df.where(F.col(c).isNotNull()).select(F.col(c).alias("x"))
    mm = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width_ok = F.col("hi") > F.col("lo")
    raw = F.floor((F.col("x") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo")))
    b = F.when(width_ok, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = (d.crossJoin(F.broadcast(mm)).groupBy(b.alias("bin"), "lo", "hi")
         .agg(F.count(F.lit(1)).alias("count")))
    # One row with at most ``bins`` counts, laid out over all bins.
    g = h.groupBy("lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("found"))
    g = g.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return g.select(F.lit(label or c).alias("measure"), "bin",
                    rnd(F.col("lo") + step * F.col("bin"), 6).alias("bin_start"),
                    rnd(F.col("lo") + step * (F.col("bin") + 1), 6).alias("bin_end"),
                    F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)).alias("count")
                    ).orderBy("measure", "bin")


# -------------------------------------------------------------- quantiles --

def quantiles(df: DataFrame, c: str, probs: Sequence[float], names: Sequence[str],
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """PERCENTILE_CONT(p) of ``c`` for each p, as one row (NULLs ignored; NULL if
    there is nothing else).

    ``percentile()`` keeps a value -> count map per group and merges the
    whole map in one task for a global aggregate; over billions of distinct
    values that does not fit. Here the bucket totals say which buckets hold the
    order statistics asked for, and only the distinct values of those few
    buckets are ranked. ``exact=False`` uses ``percentile_approx`` instead.
    """
    if not exact:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(n)
                        for p, n in zip(probs, names)])
    vc = value_counts(df, c)
    offsets = bucket_offsets(vc)
    # Two order statistics per probability, numbered 2k and 2k + 1.
    at = [F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    places = F.array(*[F.struct(F.lit(2 * k + up).alias("place"), F.least(a + up, F.col("n") - 1).alias("i"))
                       for k, a in enumerate(at) for up in (0, 1)])
    n = offsets.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"))
    wanted = n.where("n > 0").select("n", F.explode(places).alias("w")).select("n", "w.place", "w.i")
    # 2 * len(probs) rows against the buckets.
    held = offsets.join(F.broadcast(wanted), (F.col("offset") <= F.col("i")) & (F.col("i") < F.col("offset") + F.col("total")))
    hot = held.groupBy("bkt").agg(F.min("offset").alias("offset"), F.first("n").alias("n"),
                                  F.collect_list(F.struct("place", "i")).alias("wanted"))
    inside = vc.withColumn("bkt", bucket(F.col("v"))).join(F.broadcast(hot), "bkt")
    start = F.col("offset") + F.col("before")
    hits = inside.withColumn("before", _before()).withColumn("start", start).select(
        "n", F.col("v").cast("double").alias("v"),
        F.explode(F.filter("wanted", lambda w: (F.col("start") <= w["i"]) & (w["i"] < F.col("start") + F.col("cnt")))).alias("w"))
    values = hits.agg(F.max("n").alias("n"), *[F.max(F.when(F.col("w.place") == k, F.col("v"))).alias(f"_{k}")
                                               for k in range(2 * len(probs))])
    out = []
    for k, (p, name) in enumerate(zip(probs, names)):
        low, high = F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}")
        h = (F.col("n") - 1) * F.lit(float(p))
        out.append((low + (high - low) * (h - F.floor(h))).alias(name))
    return values.select(*out)


def grouped_quantile(df: DataFrame, by: Sequence[str], c: str, p: float, name: str) -> DataFrame:
    """(*by, ``name``): PERCENTILE_CONT(p) of ``c`` in each group (NULLs ignored; a group of nothing else has no row).

    As in :func:`quantiles`: distinct values with their counts, and only those of the buckets that hold the order statistics are
    ranked, so a group with a large share of the rows is no single task. NULL is a group of its own.
    """
    vc = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    offsets = bucket_offsets(vc, by).withColumn("n", F.sum("total").over(Window.partitionBy(*by)))
    h = (F.col("n") - 1) * F.lit(float(p))
    offsets = offsets.withColumn("low", F.floor(h)).withColumn("high", F.least(F.floor(h) + 1, F.col("n") - 1))
    # One to a few buckets of each group.
    held = offsets.where("offset <= high and offset + total > low").withColumnsRenamed({b: f"_{b}" for b in by} | {"bkt": "_bkt"}).drop("total")
    on = F.col("bkt") == F.col("_bkt")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = vc.withColumn("bkt", bucket(F.col("v"))).join(held, on).withColumn("start", F.col("offset") + _before(by))

    def at(i: str) -> Column:
        return F.max(F.when((F.col("start") <= F.col(i)) & (F.col(i) < F.col("start") + F.col("cnt")), F.col("v").cast("double")))

    found = inside.groupBy(*by).agg(F.first("n").alias("n"), at("low").alias("low"), at("high").alias("high"))
    return found.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * (h - F.floor(h))).alias(name))


def quantile_of_each(df: DataFrame, columns: dict[str, str], p: float, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row: PERCENTILE_CONT(p) of several columns (name of a column -> name of its quantile), ranked in one frame together."""
    if not exact:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(n) for c, n in columns.items()])
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns]))
    found = grouped_quantile(df.select(values.alias("s")).select("s.*"), ["c"], "x", p, "q")
    return found.agg(*[F.max(F.when(F.col("c") == c, F.col("q"))).alias(n) for c, n in columns.items()])
