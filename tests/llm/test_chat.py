"""Layouts to turns by fingerprint; formatting and reading back against a plain version."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cargolens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, layout string, record double"
U, S, A = "user", "system", "assistant"


def plain(rows):
    rows = [r[:4] for r in rows] + [(-7, 0, U, chat.PLANTED), (-7, 1, A, chat.PLANTED)]
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == A)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = chat.op13_chat_format(spark, spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA))
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted((tuple(r)[:5] for r in df.collect()), key=str) == plain(rows)


def test_conversations(spark):
    rnd = random.Random(4)
    pieces = ["<turn>", "</turn>", "<text>", "<", "/turn>", "\\", "\\\\", "\n", "### Assistant: ", "ä😀", "", " ok", "\\</turn>", "<\\turn>", '"', "{}"]
    rows = []
    for c in range(60):
        shape = rnd.choice([[U, A], [S, U, A], [U, A, U, A], [A], [U, "tool", A], ["human", A], [S, U, A, U]])
        rows += [(c, i, r, "".join(rnd.choices(pieces, k=rnd.randint(0, 9)))) for i, r in enumerate(shape)]
    check(spark, rows)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, tied and repeated turns, a conversation of many turns and one of many rows with one number."""
    rows = [(1, 0, None, "a"), (1, 0, U, None), (1, None, A, "before"), (None, 0, U, "x"), (None, 0, U, "x"), (2, 5, A, "b"), (2, 5, A, "a"), (2, 5, U, "z"),
            (3, 0, U, ""), (3, 1, A, ""), (4, -3, A, "neg"), (4, 2**40, U, "far"), (5, 0, U, "w \\<turn> " * 60_000), (5, 1, A, "é" * 400_000)]
    check(spark, rows + [(6, i, [U, A][i % 2], f"t{i}") for i in range(500)] + [(7, 1, A, f"r{i % 40}") for i in range(300)])
    check(spark, [])


def test_no_python_in_the_plan(spark):
    df = chat.op13_chat_format(spark, spark.createDataFrame([(1, 0, U, "x", "", 0.0)], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


RECORDS = [
    ({"prompt": "p", "completion": "c", "id": 3}, "prompt and completion", [(U, "p"), (A, "c")]),
    ({"system": "s", "prompt": "p", "response": "c"}, "prompt and response", [(S, "s"), (U, "p"), (A, "c")]),
    ({"question": "p", "answer": 42}, "question and answer", [(U, "p"), (A, "42")]),
    ({"instruction": "do", "input": "this", "output": "done", "meta": {"a": [1, {"b": 2}]}}, "instruction", [(U, "do\n\nthis"), (A, "done")]),
    ({"instruction": "do", "output": None}, "instruction", [(U, "do"), (A, "")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "weight": 1}]}, "messages", [(U, "a"), (A, "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages in parts", [(U, "ab")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}], "system": "s"}, "from and value", [(S, "s"), (U, "a"), (A, "")]),
    ({"messages": [{"role": "user"}]}, "messages", [(U, "")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": [{"text": "b"}]}]}, None, None),
    ({"prompt": "p"}, None, None), ({"prompt": {"text": "p"}, "response": "r"}, None, None), ({}, None, None), ([1, 2], None, None), ("text", None, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "mine") for i, (r, _, _) in enumerate(RECORDS)] + [(100, "{broken", "mine"), (101, None, "mine")]
    df = chat.format_records(spark.createDataFrame(rows, "i int, record string, layout string"), "record")
    assert df.columns == ["i", "record", "layout", "fingerprint", "layout_", "turns", "formatted", "loss_spans"]
    got = {r.i: r for r in df.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout_ == layout, RECORDS[i]
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns and got[i].back == got[i].turns
        assert got[i].loss == (None if turns is None else "".join(t for r, t in turns if r == A))
    assert got[100].fingerprint is None and got[101].fingerprint is None and got[100].formatted is None
    # Order of fields and what no layout names do not matter; different layouts differ.
    twin = spark.createDataFrame([('{"zz": [[1]], "completion": "x", "prompt": ""}',)], "r string")
    assert chat.canonical(twin, "r").first().fingerprint == got[0].fingerprint
    assert len({r.fingerprint for r in got.values() if r.layout_}) == 9


def test_structs(spark):
    df = spark.sql("SELECT named_struct('question', 'q', 'answer', 'a', 'n', 1) AS record")
    assert [tuple(t) for t in chat.canonical(df, "record").first().turns] == [(U, "q"), (A, "a")]


def test_paths(spark):
    df = spark.createDataFrame([('{"a": {"b c": [{"d": 1.5}, {"e": null}], "OBJECT": [[true]]}, "f": [], "g`<h": "x", "k": [1, "s"]}',)], "r string")
    assert df.select(chat.paths_of(F.parse_json("r"))).first()[0] == sorted(["a.OBJECT[][]", "a.b c[].d", "a.b c[].e", "f[]", "g`<h", "k[]?"])


def test_layouts_that_collide_are_refused(spark):
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([("{}",)], "r string"), "r", (*chat.LAYOUTS, chat.Layout("twin", (chat.one("user", "question"), chat.one("assistant", "answer")))))
