"""A store's totals after any batches, replays and failures."""

import random

import duckdb
import pytest

from cargolens.llm import rollups
from cargolens.llm.common import fresh_folder
from cargolens.llm.rollups import DELETE, INSERT, REVISE, Rollups

SCHEMA = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq long, documents string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def plain(batches):
    known, loose = {}, []
    for rows in batches:
        last = {}
        for i, t, op, s, lang, n, seq in rows:
            if i is None:
                if op != REVISE:
                    loose.append(((s, lang, t), 1 if op == INSERT else -1, n or 0))
            else:
                key = (seq is not None, seq, op, s is not None, s, lang is not None, lang, n or 0)
                if (i, t) not in last or key > last[i, t][0]:
                    last[i, t] = key, (op, (s, lang, t), n or 0)
        for k, (_, (op, group, n)) in last.items():
            if op == DELETE:
                known.pop(k, None)
            else:
                known[k] = group, n
    out = {}
    for group, sign, n in [(g, 1, n) for g, n in known.values()] + loose:
        d, t = out.get(group, (0, 0))
        out[group] = d + sign, t + sign * n
    return {g: v for g, v in out.items() if v != (0, 0)}


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in store.totals().collect()}


def test_batches_and_replays(spark):
    rnd = random.Random(3)
    store = Rollups(spark, fresh_folder(spark, "test-rollups"))
    assert totals(store) == {}
    batches = []
    for _ in range(4):
        batches.append([(rnd.choice([None, *range(12)]), rnd.choice(["v1", "v2", None]), rnd.choice([INSERT, INSERT, REVISE, DELETE]),
                         rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([None, 1, 5, 9]), rnd.randrange(5))
                        for _ in range(25)])
        store.commit(len(batches), frame(spark, batches[-1]))
        assert totals(store) == plain(batches)
    for again in (2, 4, 1):
        store.commit(again, frame(spark, batches[again - 1]))
        assert totals(store) == plain(batches)


def test_a_failure_between_the_two_writes(spark, monkeypatch):
    store = Rollups(spark, fresh_folder(spark, "test-rollups"))
    first = [(i, "v1", INSERT, "a", "en", i, 0) for i in range(10)]
    second = [(3, "v1", DELETE, None, None, None, 0), (4, "v1", REVISE, "b", "en", 40, 0)]
    store.commit(1, frame(spark, first))
    write = Rollups._write
    with monkeypatch.context() as m:
        m.setattr(Rollups, "_write", lambda self, df, name: write(self, df, name) if name == "changes" else 1 / 0)
        try:
            store.commit(2, frame(spark, second))
        except ZeroDivisionError:
            pass
    assert totals(store) == plain([first])
    store.commit(2, frame(spark, second))
    assert totals(store) == plain([first, second]) == {("a", "en", "v1"): (8, 38), ("b", "en", "v1"): (1, 40)}


def test_empty_batch_and_table(spark):
    store = Rollups(spark, fresh_folder(spark, "test-rollups"))
    store.commit(1, frame(spark, []))
    assert totals(store) == {}
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_tokens long")
    assert rollups.op2_token_counts(spark, docs).count() == 0


def test_query_on_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a"), (3, "w " * 30, "en", "a"), (4, "x1 y! \x0b" * 50, "en", None)],
                                 "doc_id long, text string, lang string, source string")
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollups.op2_token_counts(spark, docs).collect()}
    assert got == {("a", "en", "words-1"): (1, 30), ("a", "en", "signs-1"): (1, 30), (None, "en", "words-1"): (1, 100),
                   (None, "en", "signs-1"): (1, 200)}


def test_batches_in_any_order(spark):
    """Late batches, batches that come again with other content or none, and a store that is settled in between."""
    rnd = random.Random(5)
    store = Rollups(spark, fresh_folder(spark, "test-rollups"))
    said = {}

    def some(n):
        return [(rnd.choice([None, *range(8)]), rnd.choice(["v1", None]), rnd.choice([INSERT, INSERT, REVISE, DELETE]), rnd.choice(["a", "b"]), "en",
                 rnd.choice([1, 5, 9]), rnd.randrange(5)) for _ in range(n)]

    for batch, n in ((4, 12), (1, 12), (6, 12), (3, 8), (4, 0), (1, 5), (5, 6), (6, 0)):
        said[batch] = some(n)
        store.commit(batch, frame(spark, said[batch]))
        assert totals(store) == plain([said[b] for b in sorted(said)])
    assert store.batches() == [1, 3, 4, 5, 6]
    store.settle()
    store.settle()
    for batch, n in ((9, 10), (7, 10), (9, 0), (8, 4)):
        said[batch] = some(n)
        store.commit(batch, frame(spark, said[batch]))
        assert totals(store) == plain([said[b] for b in sorted(said)])
    with pytest.raises(ValueError):
        store.commit(6, frame(spark, []))
    store.settle()
    assert store.settled() == 9 and totals(store) == plain([said[b] for b in sorted(said)])


def test_a_late_delete_and_an_emptied_batch(spark):
    store = Rollups(spark, fresh_folder(spark, "test-rollups"))
    store.commit(1, frame(spark, [(1, "v1", INSERT, "a", "en", 5, 0)]))
    store.commit(3, frame(spark, [(1, "v1", DELETE, None, None, None, 0)]))
    store.commit(2, frame(spark, [(1, "v1", REVISE, "a", "en", 9, 0)]))
    assert totals(store) == {}
    store.commit(3, frame(spark, []))
    assert totals(store) == {("a", "en", "v1"): (1, 9)}
    store.commit(2, frame(spark, []))
    store.commit(1, frame(spark, []))
    assert totals(store) == {}


def test_query_and_sql_on_repeated_ids(spark, tmp_path):
    """Ids that repeat with other texts, and rows without an id, count alike in the store and in the SQL."""
    rnd = random.Random(8)
    docs = [(rnd.choice([None, None, *range(12)]), "\n".join(["one two three 4!"] * rnd.choice([1, 2, 6, 9])) + " x" * rnd.randrange(30), rnd.choice(["en", None]), rnd.choice(["a", "b", None]))
            for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, rollups.op2_token_counts(spark, df).collect()), key=str)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert got == sorted(con.execute(rollups.ORACLE).fetchall(), key=str)
