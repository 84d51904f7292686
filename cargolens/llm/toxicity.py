"""Toxicity by non-negative positive-unlabelled learning.

Training knows some texts to be toxic and nothing about the others, so a
text without the label is not taken to be clean. With the class prior p, the risk
of a classifier is p times its loss on the toxic texts as toxic, plus its loss on
unlabelled texts as clean less p times that of the toxic texts as clean. That
second part cannot be negative for any classifier; where the estimate is, the
classifier fits the sample, and training steps back instead.

The classifier is a logistic one in numpy over the presence of words. It is
fitted on the driver to a bounded sample, of which only the numbers of the chosen words
travel; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder

HELD_OUT_MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Bounds of the training sample, in texts, and of the vocabulary, in words.
MAX_TOXIC, MAX_UNLABELLED, MAX_WORDS = 4000, 12000, 600
#: Texts of the sample that have a word, at least, for it to be chosen.
MIN_TEXTS = 5
#: Words that speak most for toxic texts, from which the class prior is estimated besides the labels.
PRIOR_WORDS = 5
EPOCHS, RATE = 400, 0.1
#: Penalty, as a share of the prior: the toxic part of the risk is multiplied by the prior, and rare toxic texts must be able to weigh as much.
L2 = 1e-3
#: Unlabelled texts of which a word may be in none and yet be in this many of as many others (at 95 %).
UNSEEN = 3

#: Letters in lower case, digits as they are, other ASCII as spaces; the rest is kept.
TRANSLATE = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32) for b in range(256))


def tokens(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(TRANSLATE).split())


class Model:
    """Words with their weights; ``bias`` is the score of a text without any."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        found = self.weights.keys() & tokens(text)
        return 1 / (1 + float(np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(found)), -30, 30))))


def fit(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; rows are texts, columns words."""
    x = np.vstack([toxic, unlabelled]).astype(np.float32)
    n, m = len(toxic), len(unlabelled)
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, EPOCHS + 1):
        g = x @ w.astype(np.float32) + b
        p = 1 / (1 + np.exp(-g))
        as_clean = np.logaddexp(0, g)
        negative = as_clean[n:].mean() - prior * as_clean[:n].mean()
        toxic_part = np.concatenate([prior * (p[:n] - 1) / n, np.zeros(m)])
        clean_part = np.concatenate([-prior * p[:n] / n, p[n:] / m])
        slope = toxic_part + clean_part if negative >= 0 else -clean_part
        grad = np.append(x.T @ slope.astype(np.float32) + L2 * prior * w, slope.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the rows that are not held out.

    Confirmed: texts whose label is 1 in any of their label rows. Unlabelled: a sample of all texts, label or
    not. The class prior is the share of toxic among the labelled ids, or less if the most telling words
    are rarer than that among the unlabelled. Both samples
    are the rows of smallest id hash, and of rows with one id that of the smallest text hash, so reruns agree. Without a toxic text every
    score is zero; rows without an id, a text or a label teach nothing.
    """
    learn = F.col("id").isNotNull() & (id_remainder(F.col("id"), HELD_OUT_MODULUS) != HELD_OUT)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where(learn & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not positive:
        return Model({}, -30.0)
    prior = positive / n

    def sample(ids: DataFrame, most: int, role: int) -> DataFrame:
        place = F.xxhash64("id", F.lit(role))
        return ids.select("id").orderBy(place, "id").limit(most).withColumn("role", F.lit(role))

    ids = docs.select(F.col(doc_id).alias("id"))
    chosen = cut(sample(known.where("y = 1").join(ids.distinct(), "id", "left_semi"), MAX_TOXIC, 1).union(
        sample(ids.where(learn).distinct(), MAX_UNLABELLED, 0)))
    # At most MAX_TOXIC + MAX_UNLABELLED ids.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).where("text is not null").join(
        F.broadcast(chosen), "id")
    # Of rows that repeat an id one teaches, so the bound on ids is one on rows.
    texts = texts.groupBy("id", "role").agg(F.min(F.struct(F.xxhash64("text").alias("place"), "text")).alias("t")).select("role", "t.text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"role": batch.column("role"), "words": pa.array(
                [sorted(tokens(t.as_py())) for t in batch.column("text")], pa.list_(pa.binary()))})

    texts = cut(texts.mapInArrow(listed, "role int, words array<binary>"))
    size = dict(texts.groupBy("role").count().collect())
    if not size.get(1):
        return Model({}, -30.0)
    n1, n0 = float(size[1]), float(max(1, size.get(0, 0)))
    words = texts.select("role", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("role").alias("c1"), F.count_if(F.col("role") == 0).alias("c0")).where(F.col("c1") + F.col("c0") >= MIN_TEXTS)
    # Words whose share among toxic texts differs most from that among all, in standard errors.
    pooled = (F.col("c1") + F.col("c0") + 1) / F.lit(n1 + n0 + 2)
    apart = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(pooled * (1 - pooled))
    found = words.orderBy(F.desc(apart), "word").limit(MAX_WORDS).select("word", "c1", "c0").collect()
    vocabulary = [bytes(r.word) for r in found]
    # Among unlabelled texts a word that only toxic ones have is as much rarer as toxic texts are. Labels
    # may have been given to more suspicious texts than others; then that share is the smaller one.
    # Words that no unlabelled text has may be as frequent as the sample can miss.
    shares = [(max(r.c0, UNSEEN) / n0) / (r.c1 / n1) for r in found if r.c1 / n1 > r.c0 / n0][:PRIOR_WORDS]
    prior = float(np.clip(min([prior, *([float(np.median(shares))] if shares else [])]), 1e-4, 0.9))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            yield pa.record_batch({"role": batch.column("role"), "found": pa.array(
                [[place[w] for w in t.as_py() if w in place] for t in batch.column("words")], pa.list_(pa.int32()))})

    rows = texts.mapInArrow(numbered, "role int, found array<int>").collect()
    rows.sort(key=lambda r: (r.role, r.found))
    parts = {0: [r.found for r in rows if not r.role], 1: [r.found for r in rows if r.role]}
    present = {k: np.zeros((max(1, len(v)), len(vocabulary)), dtype=np.float32) for k, v in parts.items()}
    for k, v in parts.items():
        for i, found in enumerate(v):
            present[k][i, found] = 1
    w, b = fit(present[1], present[0], prior)
    return Model(dict(zip(vocabulary, w.tolist())), b)


def score(text: Column, model: Model) -> Column:
    """Probability of each text, null as '', to be toxic."""
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return scored(text.cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts score as a text without words; repeated rows score alike; a null id counts as ''
    for held_out. Whole texts are read, of any length. An empty table gives an empty frame; ``labels``
    may be empty too.
    """
    model = train(docs, labels)
    held_out = id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that do not score as toxic, columns as they are."""
    model = train(docs, labels)
    return docs.where(score(F.col("text"), model) < threshold)
