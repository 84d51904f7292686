"""Property tests (hypothesis): ranking and quantiles against numpy on
random inputs with many ties, with value ranges forced small so the ranged
path is exercised."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cargolens.functions import stats

values = st.lists(st.integers(min_value=-20, max_value=20), min_size=2, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, steps=st.integers(min_value=1, max_value=10))
def test_average_ranks_property(spark, monkeypatch, xs, steps):
    monkeypatch.setattr(stats, "BUCKET_STEPS", steps)
    df = spark.createDataFrame(pd.DataFrame({"x": np.array(xs, dtype=float)}))
    r = stats.average_ranks(stats.value_counts(df, "x")).toPandas().set_index("v")["rank"]
    s = pd.Series(xs, dtype=float)
    assert np.allclose(s.map(r).values, s.rank(method="average").values)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, p=st.floats(min_value=0.0, max_value=1.0), steps=st.integers(1, 10))
def test_quantile_property(spark, monkeypatch, xs, p, steps):
    monkeypatch.setattr(stats, "BUCKET_STEPS", steps)
    df = spark.createDataFrame(pd.DataFrame({"x": np.array(xs, dtype=float)}))
    got = stats.quantiles(df, "x", [p], ["q"]).first()["q"]
    assert got == pytest.approx(float(np.percentile(np.array(xs, dtype=float), p * 100)), abs=1e-9)
