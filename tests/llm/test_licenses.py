"""Canonical forms and look-ups."""

from cargolens.llm import licenses
from cargolens.llm.licenses import KNOWN, known_licenses, scan

SCHEMA = "doc_id long, text string, license string, digest string, row long"


def look_up(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    return [(r.license, r.notices, r.n_notices) for r in sorted(scan(df, known_licenses(spark)).collect(), key=lambda r: r.doc_id)]


def test_spellings_case_and_copyright_lines(spark):
    isc = dict(KNOWN)["ISC"]
    shouted = "Copyright (c) 2020 Someone\n(c) 2021 Other\n\n" + isc.upper().replace("LICENSE", "LICENCE").replace(",", " ,  ")
    got = look_up(spark, [isc, shouted, isc + "\nAnd one line more.", "RELEASED under the mit licence", "Prose.\n- Licensed under CC BY-NC 4.0\nProse.",
                          "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nreleased under the MIT licence!"])
    assert got[0][0] == got[1][0] == "ISC" and got[2][0] is None
    assert got[3] == ("MIT", "MIT", 1) and got[4] == (None, "CC-BY-NC-4.0", 1)
    assert got[5] == (None, "CC-BY-NC-4.0,MIT", 3)


def test_odd_rows(spark):
    got = look_up(spark, [None, "", "\n\n", "Copyright 2020 X", "... !!", "word " * 100_000, "Released under the MIT License.", "Released under the MIT License."])
    assert got[:6] == [(None, "", 0)] * 6 and got[6] == got[7] == ("MIT", "MIT", 1)
    empty = spark.createDataFrame([], SCHEMA)
    assert scan(empty, known_licenses(spark)).count() == 0
    assert look_up_with(spark, [("A", "x y")], ["X, y.", "x z"]) == ["A", None]
    assert look_up_with(spark, [("none", "...")], ["...", "x"]) == [None, None]


def look_up_with(spark, known, texts):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r.license for r in sorted(scan(df, known_licenses(spark, known)).collect(), key=lambda r: r.doc_id)]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "x", "x", "y", 1)], SCHEMA)
    plan = licenses.op9_licenses(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def entire(name):
    return next(text for n, text in licenses.entire_texts() if n == name)


def test_entire_licenses_in_other_dress(spark):
    """Every entire licence is found as it is, broken elsewhere, in a comment, with typographic signs and under its holders' lines."""
    names = sorted({n for n, _ in licenses.entire_texts()})
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
            "MPL-2.0", "CC0-1.0"} <= set(names)
    assert [g[0] for g in look_up(spark, [entire(n) for n in names])] == names
    short = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "0BSD")
    owners = ("# Copyright 2020 Someone", "// Copyright (c) 2020 Someone", " * Copyright Jane Doe", "Copyright The Foo Authors", "Copyright \u00a9 Doe",
              "(c) Jane Doe", "Copyright [yyyy] [name]", "# All rights reserved.")
    texts, want = [], []
    for n in short:
        words = entire(n).split()
        for width in (1, 3, 8, 1000):
            lines = [" ".join(words[i:i + width]) for i in range(0, len(words), width)]
            texts.append("\n".join(owners) + "\n\n" + "\n".join("# " + line for line in lines))
            texts.append("\n".join(lines).replace("\"AS IS\"", "\u201cAS IS\u201d").replace("'as-is'", "\u2018as\u2011is\u2019").replace("non-", "non\u2013"))
            want += [n, n]
    assert [g[0] for g in look_up(spark, texts)] == want
    apache = entire("Apache-2.0").split("\n")
    at = next(i for i, line in enumerate(apache) if line.strip().startswith("(c) You must"))
    apache[at:at + 2] = [" ".join(apache[at:at + 2])]
    cut_short = [line for line in apache if "(c) You must" not in line]
    assert [g[0] for g in look_up(spark, ["\n".join(apache), "\n".join(cut_short), "MIT License\n\nCopyright (c) 2020 X\n\n" + entire("MIT")])] == [
        "Apache-2.0", None, "MIT"]


def test_the_oracle_agrees_on_copyright_lines(spark):
    import duckdb
    lines = ["copyright holders", "copyright notice", "copyright jane", "copyright the software", "copyright the foo", "# copyright x", "copyright", "(c) you must", "(c) doe",
             "copyright not", "copyright noticeable", "copyright: doe", "copyright \u00e9lan", "copyrighted work"]
    here = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").orderBy("i").select(
        licenses.F.col("l").rlike(licenses.COPYRIGHT_LINE)).collect()]
    assert here == [duckdb.execute("SELECT regexp_matches(?, ?)", [x, licenses.COPYRIGHT_LINE]).fetchone()[0] for x in lines]
    assert here == [False, False, True, False, True, True, False, False, True, True, True, True, True, False]
