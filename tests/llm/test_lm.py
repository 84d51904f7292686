"""The automaton's scores against a plain dictionary model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cargolens.llm import lm

SCHEMA = "doc_id long, text string, lang string, n_tokens long"


def plain(rows, order=lm.ORDER):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by direct recursion."""
    texts = [(i, [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["end"]) for i, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % lm.HELD_OUT_MODULUS == 0 for i, _ in texts]
    grams, follow = Counter(), defaultdict(set)
    for (_, words), out in zip(texts, held):
        if not out:
            line = ["begin", *words]
            for j in range(len(line)):
                for k in range(1, order + 1):
                    if j - k + 1 >= 0:
                        g = tuple(line[j - k + 1:j + 1])
                        grams[g] += 1
                        follow[g[:-1]].add(g[-1])
    single = {g: c for g, c in grams.items() if len(g) == 1 and g != ("begin",)}
    n, v = sum(single.values()), len(single)

    def p(g):
        if len(g) == 1:
            return (single.get(g, 0) + lm.ADD) / (n + lm.ADD * (v + 1))
        h = grams[g[:-1]]
        if not h or not follow[g[:-1]]:
            return p(g[1:])
        return (max(grams[g] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(follow[g[:-1]]) * p(g[1:])) / h

    for (i, words), out in zip(texts, held):
        line = ["begin", *words]
        score = sum(math.log10(p(tuple(line[max(0, j - order + 1):j + 1]))) for j in range(1, len(line)))
        base = sum(math.log10(p((w,))) for w in words)
        yield i, out, len(words), sum((w,) in single for w in words), n, base, score


def check(spark, rows):
    got = lm.op10_lm(spark.createDataFrame(rows, SCHEMA)).collect()
    want = list(plain(rows))
    key = lambda r: tuple((x is None, x) for x in (r[0], *r[2:4], round(r[5], 6)))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-7)


def test_against_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 40)
    monkeypatch.setattr(lm, "RANGE_ENTRIES", 50)
    monkeypatch.setattr(lm, "PIECE", 7)
    words = "a b c the of The a a b zz".split()
    rows = [(i, " ".join(words[(i * j + j // 3) % len(words)] for j in range(i % 23)), "x", 1) for i in range(60)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", 1), (None, "a b a", "en", 2), (None, "a b a", "en", 2),
            (3, "A\tb\n a", None, 3), (3, "A\tb\n a", None, 3), (4, "unseen word " * 3000, "en", 4),
            (20, " only  spaces \x0b", "en", 5)]
    check(spark, rows)


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % lm.HELD_OUT_MODULUS == 0)
    check(spark, [(held, "a b", "en", 1)])
    assert lm.op10_lm(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probabilities_sum_to_one(spark):
    """After any context, the words seen, the end and one unknown word share the whole mass."""
    rows = [(i, "a b a c b a", "en", 1) for i in (1, 2, 3)] + [(5, "b a", "en", 1)]
    texts = ["a b a", "a b b", "a b c", "a b unknown", "a b"]
    probe = [(100 + i, t, "en", 1) for i, t in enumerate(texts)]
    held = [j for j in range(10_000) if zlib.crc32(str(j).encode()) % lm.HELD_OUT_MODULUS == 0][:len(texts)]
    probe = [(h, t, "en", 1) for h, t in zip(held, texts)]
    want = {r[0]: r for r in plain(rows + probe)}
    got = {r[0]: r for r in lm.op10_lm(spark.createDataFrame(rows + probe, SCHEMA)).collect()}
    for h in held:
        assert got[h]["score"] == pytest.approx(want[h][6], abs=1e-9)
    assert got[held[0]]["score"] > got[held[0]]["base_score"]


def test_held_out_texts_are_better_predicted_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.op10_lm(docs).where("held_out").agg({"score": "sum", "base_score": "sum", "doc_id": "count"}).first()
    assert held["count(doc_id)"] > 50 and held["sum(score)"] > held["sum(base_score)"]


def test_different_keys():
    """As np.unique, with any place of a key that repeats."""
    keys = np.random.default_rng(3).integers(0, 2**64, 400, dtype=np.uint64)
    keys = np.concatenate([keys, keys[::3], keys[:1].repeat(100), keys[:0]])
    key, place, which = lm.different(keys)
    want, number = np.unique(keys, return_inverse=True)
    assert (key == want).all() and (which == number).all() and (keys[place] == key).all()
    assert lm.different(keys, False)[2] is None and len(lm.different(keys[:0])[0]) == 0
