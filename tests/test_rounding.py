"""The cross-engine rounding rule: Spark's rnd() and the oracle's R() give
the same doubles, including decimal ties that double rounding splits."""

import duckdb
import numpy as np
import pandas as pd

from cargolens.functions.exprs import rnd
from cargolens.plans.oracle_base import R


def test_rnd_matches_duckdb(spark):
    rng = np.random.default_rng(3)
    ties = [1.005, 2.345, 0.125, -0.25, -1.005, 12.25, 1.05, 0.15, 2.675, 1e6 + 0.5, -0.049999999]
    vals = np.concatenate([ties, rng.normal(0, 100, 3000), rng.integers(-10**6, 10**6, 500) / 1000.0])
    pdf = pd.DataFrame({"i": np.arange(len(vals)), "x": vals})
    df = spark.createDataFrame(pdf)
    got = {}
    for d in (0, 1, 2, 4, 6):
        for r in df.select("i", rnd("x", d).alias("r")).collect():
            got[(r["i"], d)] = r["r"]
    con = duckdb.connect()
    con.register("v", pdf)
    for d in (0, 1, 2, 4, 6):
        for i, r in con.execute(f"SELECT i, {R('x', d)} FROM v").fetchall():
            assert got[(i, d)] == r, (vals[i], d, got[(i, d)], r)
    # half away from zero on the decimal value, as PostgreSQL numeric
    assert got[(0, 2)] == 1.01 and got[(1, 2)] == 2.35 and got[(3, 1)] == -0.3


def test_kpi_text_format(spark):
    from pyspark.sql import functions as F

    from cargolens.operators.report import _fmt
    df = spark.createDataFrame([(13541712.784, 98353, 8.0999, -0.17704, 12.45)],
                               "rev double, n long, late double, rho double, days double")
    r = df.select(F.concat(F.lit("R$ "), _fmt("rev", 2)).alias("rev"),
                  F.format_number(F.col("n"), 0).alias("n"),
                  F.concat(_fmt("late", 1), F.lit("%")).alias("late"),
                  F.concat(F.lit("ρ = "), _fmt("rho", 3)).alias("rho"),
                  _fmt("days", 1).alias("days")).first()
    assert (r["rev"], r["n"], r["late"], r["rho"]) == ("R$ 13,541,712.78", "98,353", "8.1%", "ρ = -0.177")
    assert r["days"] == "12.5"          # half away from zero on the decimal value
