"""Held-out accuracy, the risk estimator, odd rows."""

import math

import numpy as np
import pytest

from cargolens.llm import toxicity
from cargolens.llm.toxicity import fit, tokens

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels)
    return got.join(labels, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id").toPandas()


def test_held_out(scored):
    held = scored[scored.held_out & scored.toxic.notna()]
    y, s = held.toxic.astype(int).to_numpy(), held.score.to_numpy()
    order = np.argsort(np.argsort(s, kind="stable")) + 1.0
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    caught, precision = held.predicted[y == 1].mean(), y[held.predicted == 1].mean()
    assert precision > 0.9 and caught > 0.6 and auc > 0.75
    assert held.predicted[y == 0].mean() < 0.02
    assert ((scored.predicted == 1) == (scored.score >= 0.7)).all() and scored.score.between(0, 1).all()


def test_risk_does_not_go_negative():
    """Words that only the toxic sample has are learned, and unlabelled toxic texts are not taken for clean."""
    rnd = np.random.default_rng(4)
    truth = rnd.random(3000) < 0.3
    sign = (truth & (rnd.random(3000) < 0.9))[:, None]
    x = np.hstack([sign, rnd.random((3000, 20)) < 0.3]).astype(float)
    toxic, unlabelled = x[truth][:400], x[400:]
    w, b = fit(toxic, unlabelled, 0.3)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert (p[truth & sign[:, 0]] > 0.7).mean() > 0.97 and (p[~truth] < 0.5).mean() > 0.98


@pytest.mark.parametrize("prior", [0.1, 0.95])
def test_fit_against_finite_differences(prior):
    """The estimator with slopes by central differences instead of formulas: the same weights where the risk has its minimum. A prior that
    is too large drives the clean part of the risk below zero; it is pushed back, and ends near zero in both."""
    rnd = np.random.default_rng(2)
    toxic, unlabelled = (rnd.random((60, 3)) < [0.7, 0.4, 0.6]).astype(float), (rnd.random((200, 3)) < [0.3, 0.5, 0.4]).astype(float)

    def parts(w):
        t, u = (x @ w[:3] + w[3] for x in (toxic, unlabelled))
        return prior * np.logaddexp(0, -t).mean() + toxicity.L2 * prior / 2 * (w[:3] ** 2).sum(), np.logaddexp(0, u).mean() - prior * np.logaddexp(0, t).mean()

    def slope(f, w):
        return np.array([(f(w + d) - f(w - d)) / 2e-5 for d in np.eye(4) * 1e-5])

    w, mean, square, pushed = np.array([0.0, 0.0, 0.0, math.log(prior / (1 - prior))]), np.zeros(4), np.zeros(4), 0
    for t in range(1, toxicity.EPOCHS + 1):
        negative = parts(w)[1] < 0
        pushed += negative
        grad = slope((lambda v: -parts(v)[1] + toxicity.L2 * prior / 2 * (v[:3] ** 2).sum()) if negative else (lambda v: sum(parts(v))), w)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w - toxicity.RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    got, bias = fit(toxic, unlabelled, prior)
    got = np.append(got, bias)
    if prior == 0.1:
        assert not pushed and got == pytest.approx(w, abs=0.02) and sum(parts(got)) == pytest.approx(sum(parts(w)), abs=1e-4)
        assert np.abs(slope(lambda v: sum(parts(v)), got)).max() < 1e-3
    else:
        assert pushed and parts(got)[1] > -0.05 and parts(w)[1] > -0.05


def test_ids_that_repeat_teach_once(spark):
    """A third of all rows with one id: the model is that of one row of it."""
    docs = [(i, "you idiot scum" if i % 4 == 0 else "plain good words", None) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 120, 2)], LABELS)
    models = [toxicity.train(spark.createDataFrame(docs + more, DOCS), labels) for more in ([], [docs[4]] * 60)]
    assert models[0].__dict__ == models[1].__dict__


def test_odd_rows(spark):
    docs = [(i, "you idiot scum " * 3 if i % 4 == 0 else "plain good words", None) for i in range(200)]
    docs += [(500, None, "x"), (501, "", "x"), (None, "idiot, SCUM!", "x"), (3, "plain good words", None), (502, "IDIOT SCUM " * 45_000, "x")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(0, 1, 0), (None, 1, 1), (7, None, None)]
    got = toxicity.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[502].predicted == 1 and by[None].predicted == 1 and by[500].predicted == 0 and by[500].score == by[501].score
    again = toxicity.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score_documents(docs, none).collect()] == [0, 0]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0
    unknown = spark.createDataFrame([(i, 1, 1) for i in range(900, 910)], LABELS)
    assert toxicity.score_documents(docs, unknown).count() == 2


def test_keep_clean(spark):
    docs = spark.createDataFrame([(i, "idiot" if i % 4 == 0 else "fine", "c") for i in range(120)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], LABELS)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"fine"} and kept.count() == 90


def test_tokens():
    assert tokens("Ünder-way, A1 B\x0bc".encode()) == {"Ünder".encode(), b"way", b"a1", b"b", b"c"}


@pytest.mark.parametrize("share", [0.1, 0.02, 0.005, 0.001])
def test_rare_toxic_texts_reach_the_threshold(share):
    """Ten words, each in 30 % of toxic texts and in no clean one, beside common words: as many texts with them are found at any share."""
    rnd = np.random.default_rng(6)

    def texts(n, toxic):
        return np.hstack([(rnd.random((n, 10)) < 0.3) & toxic[:, None], rnd.random((n, 100)) < 0.2]).astype(float)

    toxic = texts(1000, np.ones(1000, bool))
    w, b = fit(toxic, texts(12_000, rnd.random(12_000) < share), share)
    held = texts(20_000, np.arange(20_000) < 4000)
    found = held @ w + b >= np.log(0.7 / 0.3)
    signed = held[:4000, :10].any(axis=1)
    assert found[:4000][signed].mean() > 0.75 and found[4000:].mean() < 0.005


@pytest.mark.parametrize("every", [200, 1000])
def test_rare_toxic_texts(spark, every):
    """Toxic shares of 0.5 % and 0.1 %, whose words the labels and texts hold but few of."""
    rnd = np.random.default_rng(8)
    bad, good = [f"slur{i}" for i in range(10)], [f"word{i}" for i in range(60)]
    docs = []
    for i in range(24_000):
        words = [w for w, r in zip(good, rnd.random(60)) if r < 0.2] + [w for w, r in zip(bad, rnd.random(10)) if r < 0.3 and i % every == 0]
        docs.append((i, " ".join(words), None))
    labels = [(i, 1, int(i % every == 0)) for i in range(24_000)]
    got = toxicity.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    signed = {i for i, t, _ in docs if "slur" in t}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id in signed]) > 0.5
    assert np.mean([r.predicted for r in held if r.doc_id not in signed]) < 0.002


def test_words_that_no_unlabelled_text_has(spark, monkeypatch):
    """The prior is then what the sample can miss, and not 1e-4."""
    priors = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, unlabelled, prior: (priors.append(prior), fit(toxic, unlabelled, prior))[1])
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 100)
    docs = spark.createDataFrame([(i, "vile scum" if i < 20 else "fine", None) for i in range(20_000)], DOCS)
    toxicity.train(docs, spark.createDataFrame([(i, 1, int(i < 20)) for i in range(200)], LABELS))
    assert priors[0] >= 3 / 100
