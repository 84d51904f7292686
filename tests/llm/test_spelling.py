"""Spelling variants against plain counting and all-pairs edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from cargolens.llm import spelling

SCHEMA = "doc_id long, text string, word string, n double"


def plain_counts(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts):
    rows, forms = [], {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * n:
            forms[w] = best
        rows.append((w, n, len(close)))
    out = []
    for w, n, n_near in rows:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, n_near, counts.get(forms.get(w))))
    return sorted(out)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def random_words(n, letters, seed=1):
    rnd = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice([6, 6, 7, 8, 9])))
        out[w] = rnd.choice([5, 6, 30, 200, 900])
    return out


@pytest.mark.parametrize("most", [2048, 4, 1])
def test_variants(spark, most):
    """Random words over few letters, among them repeated letters; groups dealt again down to single places."""
    counts = random_words(150, "abé") | random_words(60, "aab", 2) | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 700}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.variants(df, most=most)) == plain(counts)


def test_hot_prefix(spark):
    """Words that nearly all share their first half: found whole, in bounded groups."""
    counts = {f"common{a}{b}{c}": 5 + 40 * (a == "x") for a in "abcdefx" for b in "ghijk" for c in "lmnopqrst"} | random_words(40, "xyz")
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.variants(df, most=20)) == plain(counts)
    groups = spelling.groups(df, 20).selectExpr("size(rows) AS n", "head + tail < longer - 1 AS coarse")
    assert groups.where("coarse").agg({"n": "max"}).first()[0] <= 20


def test_documents(spark):
    """Whole texts: case, letters beyond ASCII, odd rows, repeated rows, a long text, a run of 50,000 letters, runs that lose a letter."""
    base = ["Spelling Variant groups", "spelling VARIANT grooups×÷ÀÀÀÀÀ", "naïveté naivete'naïvetes", "x" * 50_000]
    docs = [(i, base[i % 4]) for i in range(1200)] + [(None, "Spelling variants"), (7, None), (8, ""), (9, "speling " * 40_000)] + [(10, base[0])] * 30
    counts = plain_counts(docs)
    assert any(w not in " ".join(t or "" for _, t in docs).lower() for w in counts)  # some words exist by damage alone
    df = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], SCHEMA)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == counts
    assert rows(spelling.op11_spelling_variants(df)) == plain(counts)


def test_small_tables_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(i, f"wordlike{'abcdefg'[i % 7]} Wordlikes") for i in range(60)]
    assert rows(spelling.op11_spelling_variants(spark.createDataFrame([(*d, "", 0.0) for d in docs], SCHEMA))) == plain(plain_counts(docs))
    assert spelling.op11_spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.op11_spelling_variants(spark.createDataFrame([(1, "short text", "", 0.0)], SCHEMA)).count() == 0


def test_given_table(spark):
    """Counts and links of the smallest driver table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows(spelling.op11_spelling_variants(docs)) == plain(counts)
