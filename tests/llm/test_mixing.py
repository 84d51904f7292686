"""Targets and words taken against plain water-filling."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_pipeline import plain_mix

from cargolens.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target double"


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], SCHEMA)
    return mixing.mix(df).collect()


def check(spark, rows):
    out = got(spark, rows)
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        s = by.setdefault(r.source, {"target": r.target, "size": r.source_size, "taken": 0, "own": 0})
        s["taken"] += r.taken
        s["own"] += r["size"]
    for s in by.values():
        assert s["own"] == s["size"] and abs(s["taken"] - s["target"]) <= 0.5 and s["target"] <= 3 * s["size"] + 1e-9
    assert sum(s["target"] for s in by.values()) == pytest.approx(total)
    assert sorted(map(str, got(spark, rows))) == sorted(map(str, out))
    # Whole documents come as near to the words taken as half of a source's last document.
    for s, words_of in by.items():
        mixed = sum(len(t.split()) for _, t in plain_mix([(i, q, t or "") for i, q, t in rows], s))
        assert abs(mixed - words_of["taken"]) <= max(len((t or "").split()) for _, q, t in rows if q == s) / 2


def test_hot_and_small_sources(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 11}", words(1 + i * 37 % 90)) for i in range(300)]
    check(spark, rows + [(1000, "tiny", "one"), (1001, "long", words(20_000))])


def test_odd_rows(spark):
    check(spark, [(1, None, "a b c"), (2, None, None), (3, "x", ""), (None, "x", "a b"), (None, "x", "a b"), (4, "y", "c d e f"),
                  (4, "y", "c d e f"), (5, "z", None)])


def test_no_words_and_empty_table(spark):
    assert {(r.target, r.taken) for r in got(spark, [(1, "a", None), (2, "b", "")])} == {(0.0, 0)}
    assert got(spark, []) == []
    assert mixing.repeat_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_documents(spark, monkeypatch):
    """Every text whole, as often as the plain version has it, also where one row is taken in many lots."""
    rows = [(1, "a", words(10)), (1, "a", words(10)), (2, "a", " lead " + words(7)), (3, "b", words(500)), (4, "c", words(40)), (5, "c", None), (6, "b", "")]
    rows += [(7, "d", "the same row")] * 60
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], SCHEMA)
    want = sorted(plain_mix([(i, s, t or "") for i, s, t in rows]))
    assert any(t == "the same row" for _, t in want)
    for lot in (1000, 3):
        monkeypatch.setattr(mixing, "LOT", lot)
        out = mixing.repeat_documents(df)
        assert out.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.integers(0, 40)), max_size=25))
def test_any_sizes(spark, sizes):
    check(spark, [(i, s, words(n)) for i, (s, n) in enumerate(sizes)])


def test_native_plan(spark):
    """No Python in the plan."""
    df = spark.createDataFrame([(1, "a", "x y", "s", 0.0)], SCHEMA)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
