"""Spelling variants: words one edit away from a far more frequent word.

Two words differ by one inserted, deleted or replaced code point exactly if their lengths differ
by at most one and their common prefix and common suffix together reach the longer length minus one.
Words meet in groups that share a prefix or a suffix of half that length, which every such pair does. A
task lays a group's words out as a padded matrix of code points, forward and backward, and compares its rows tile by
tile. A group with too many words is dealt again by half of what is left to agree, as often as needed, so that no
task holds an unbounded group and no pair is lost; every pair is found in one group only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Runs of letters; a word is one of these.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: One run in so many loses a code point (noise to find).
DAMAGE = 199
#: Words in a group at most, before it is dealt again by finer keys.
GROUP = 2048
#: Cells of a tile's matrix of comparisons.
CELLS = 1 << 22
#: Different words a counting task keeps before it passes them on.
HELD = 200_000
GROUP_KEY = ["key", "longer", "head", "tail", "under"]


def counter(least: int, damage: int | None):
    """Words of (doc_id string, text) batches with how often each occurs there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN[:-1] + f"{{{least},}}")  # a run loses a code point at most, so shorter ones give no word
        lower = {i: i + 32 for i in range(65, 91)}
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for raw, n in Counter(map(re.Match.group, runs.finditer(text))).items():
                    word = raw.translate(lower)
                    if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield pa.record_batch({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.record_batch({"word": list(held), "n": list(held.values())})
    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n): words of all whole texts, lower-cased in A-Z, that are long and frequent enough.

    A null text has none; a null id counts as ''. Rows that repeat count as often as they stand there.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(counter(least_length, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def keyed(rows: DataFrame, longer: Column, head: Column, tail: Column, under: Column) -> DataFrame:
    """``rows`` by what their words must share: the first ``head`` and last ``tail`` code points, in pairs whose
    longer word has ``longer`` and whose common prefix is shorter than ``under``."""
    rows = rows.select("word", "n", longer.cast("int").alias("longer"), head.cast("int").alias("head"), tail.cast("int").alias("tail"),
                       under.cast("int").alias("under"))
    # A hash keeps the key short; what it brings together by chance is told apart when rows are compared.
    ends = F.xxhash64("longer", "head", "tail", "under", F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("key", ends)


def dealt(rows: DataFrame) -> DataFrame:
    """Each row twice, by half of what is left to agree: a longer common prefix, or, where the prefix is shorter, a longer common suffix."""
    left = F.col("longer") - 1 - F.col("head") - F.col("tail")
    half = F.ceil(left / 2)
    sides = F.array(F.struct((F.col("head") + half).alias("h"), F.col("tail").alias("t"), F.col("under").alias("u")),
                    F.struct(F.col("head").alias("h"), (F.col("tail") + F.floor(left / 2) + 1).alias("t"), (F.col("head") + half).alias("u")))
    rows = rows.select("word", "n", "longer", F.explode(sides).alias("s"))
    return keyed(rows, F.col("longer"), F.col("s.h"), F.col("s.t"), F.col("s.u"))


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """Groups of words (arrays) in one of which any two words one edit apart meet, ``most`` words each (or those that
    differ in one place alone, which the alphabet bounds)."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer")).where("longer > 1")
    pending = dealt(rows.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.col("longer").alias("under")))
    ready = []
    while True:
        pending = cut(pending)
        sizes = cut(pending.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("words"), F.max(length).alias("longest")).where(
            "words > 1 and longest = longer").withColumn("again", F.expr(f"words > {most} and head + tail < longer - 1")))
        # Both sides are files, so a group with a large share of the words is split.
        pending = pending.join(sizes.select(*GROUP_KEY, "again"), GROUP_KEY)
        ready.append(pending.where(~F.col("again")).groupBy(*GROUP_KEY).agg(F.collect_list(F.struct("word", "n")).alias("rows")))
        if sizes.where("again").isEmpty():
            break
        pending = dealt(pending.where("again"))
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def code_points(words: list[str], width: int, backward: bool) -> np.ndarray:
    """One row a word, filled up with zeros after its end; backward: each word from its last code point."""
    flat = "".join([(w[::-1] if backward else w).ljust(width, "\0") for w in words])
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, width)
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points


def agreeing(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading code points rows a and b of the matrix share."""
    same = m[a] == m[b]
    return np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every pair one edit apart: (word, near, near_n)."""
    for batch in batches:
        lists = batch.column("rows")
        words, n = lists.flatten().field("word").to_pylist(), lists.flatten().field("n").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        longer, head, tail, under = (batch.column(c).to_numpy() for c in GROUP_KEY[1:])
        first = np.cumsum(sizes) - sizes
        for width in np.unique(longer).tolist():
            which = np.flatnonzero(longer == width)
            rows = np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in which])
            group = np.repeat(which, sizes[which])
            own = [words[r] for r in rows]
            length = np.array([len(w) for w in own])
            ahead, back = code_points(own, width, False), code_points(own, width, True)
            # A row meets those after it in its group; tiles hold so many rows that their comparisons stay bounded.
            end = np.repeat(np.cumsum(sizes[which]), sizes[which])
            meets = end - np.arange(len(rows)) - 1
            tile = np.cumsum(meets) * width // CELLS
            for lot in np.unique(tile[meets > 0]).tolist():
                of = np.flatnonzero((tile == lot) & (meets > 0))
                a = np.repeat(of, meets[of])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(meets[of]) - meets[of], meets[of])
                some = np.maximum(length[a], length[b]) == width
                a, b = a[some], b[some]
                shorter = np.minimum(length[a], length[b])
                prefix, suffix = (np.minimum(agreeing(m, a, b), shorter) for m in (ahead, back))
                g = group[a]
                hit = (prefix + suffix >= width - 1) & (shorter >= width - 1) & (prefix >= head[g]) & (suffix >= tail[g]) & (prefix < under[g])
                a, b = a[hit], b[hit]
                if len(a):
                    yield pa.record_batch({"word": [own[i] for i in a] + [own[i] for i in b], "near": [own[i] for i in b] + [own[i] for i in a],
                                           "near_n": np.concatenate([n[rows[b]], n[rows[a]]])})


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, in steps of doubling length. ``forms``: (word, form), each word once.

    A form occurs more often than its word, so there are no circles and only as many steps as a count has digits.
    """
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        if longer.where("went").isEmpty():
            return state
        state = longer.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words``: (word string, n long), each word once.

    form: the near word of the largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times the
    word's, else null with form_n null. root: the last of the forms' forms, the word itself without a form. No words give an empty frame.
    """
    words = cut(words)
    near = groups(words, most).select("rows", *GROUP_KEY[1:]).mapInArrow(near_pairs, "word string, near string, near_n long")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("b"))
    is_form = -F.col("b.rank") >= ratio * F.col("n")
    found = cut(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("b.rank")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of all whole documents, as its contract names them.

    Null texts have no words and a null doc_id counts as ''; empty texts and an empty table give no rows; other columns are not read.
    """
    return variants(word_counts(docs))
