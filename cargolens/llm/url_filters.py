"""URL filters: rules first, then segmented host and path words under naive Bayes.

A rule names a host and a path; it fits the host and its subdomains, and the
longest rule that fits gives its verdict. The other URLs are judged by their
words. A host label such as ``cheappillsonline`` is one run of letters, so it is split first: a
unigram model, counted over the words of the pages themselves, gives each word a
probability, and the Viterbi path is the most probable way to cut the run. Then a
multinomial naive Bayes classifier scores the different words of host and path.

Nobody labels URLs, so the classifier learns from the pages in two steps: a URL
with a seed word among its segmented words is an example to block, any other
one to allow. What it learns beyond the seeds are the words that come with them.

Different runs are segmented once, different hosts and paths scored once, and the scores joined
to the pages; the joins stand between plain shuffles, so a host with any share of
the pages is split by adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

BLOCK, ALLOW = "block", "allow"
#: The rules of the contract: verdict, host, path.
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: Words that make a URL an example to block.
SEEDS = ("adult", "porn", "xxx", "sex", "casino", "poker", "bet", "bets", "betting", "gambling", "pill", "pills", "viagra", "pharmacy", "cheap",
         "ads", "adserver", "banner", "track", "tracker", "popup", "spam", "malware", "phishing", "warez", "torrent")
#: Longest word that segmentation knows, and the share of all counted words that each seed brings, so that runs are cut alike in small and large tables.
MAX_WORD, SEED_SHARE = 24, 1e-4
SMOOTHING = 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both '' for null and without ``://``."""
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, both null without one; of equally
    long rules the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        first = not any(len(r[1] + r[2]) == len(h + p) for r in rules[:rules.index((v, h, p))])
        fits = fits if first else fits & name.isNull()
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def runs(text: Column) -> Column:
    """Runs of letters, and of digits as '#'."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(found, lambda r: F.when(r.rlike("^[0-9]"), "#").otherwise(r))


def page_words(html: Column) -> Column:
    """Words of a page's visible text, of ASCII letters."""
    text = F.regexp_replace(ascii_lower(html), r"(?s)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", " ")
    return F.regexp_extract_all(text, F.lit(rf"(?<![a-z\x{{80}}-\x{{10FFFF}}])[a-z]{{1,{MAX_WORD}}}(?![a-z\x{{80}}-\x{{10FFFF}}])"), F.lit(0))


def word_counts(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(word, n): how often the pages' texts have a word; the seeds are words, too. The pages are read once, now."""
    counted = cut(pages.select(F.explode(page_words(F.col("html"))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")))
    each = math.ceil((counted.agg(F.sum("n")).first()[0] or 1) * SEED_SHARE)
    seeded = pages.sparkSession.createDataFrame([(s, each) for s in dict.fromkeys(seeds)], "word string, n long")
    return counted.union(seeded).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, words: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable cut of ``run``; ``words`` has the count of the known word at (start, length).

    An unknown piece of n letters has probability 10 / (total * 10^n); of equally probable cuts that
    with the shorter last word wins, and so on from the end.
    """
    best = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        ways = []
        for size in range(1, min(MAX_WORD, end) + 1):
            n = words.get((end - size, size))
            p = math.log10(n / total) if n else 1 - math.log10(total) - size
            ways.append((best[end - size][0] + p, -size))
        p, size = max(ways)
        best.append((p, -size))
    cut_at, end = [], len(run)
    while end:
        cut_at.append(run[end - best[end][1]:end])
        end -= best[end][1]
    return cut_at[::-1]


def segment(different: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words array<string>) of different runs of letters, under the unigram counts ``words``.

    Every substring of a run up to MAX_WORD letters is looked up by a join, so the
    vocabulary stays where it is; a run gets back the words that it contains.
    """
    total = int(words.agg(F.sum("n")).first()[0])
    sizes = F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("run") - F.col("start")))
    pieces = different.where("run <> '' and run <> '#'").select(
        "run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start")).select(
        "run", "start", F.explode(sizes).alias("size")).withColumn("word", F.substring("run", F.col("start") + 1, F.col("size")))
    known = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [viterbi(r["run"], {(k["start"], k["size"]): k["n"] for k in r["known"] or ()}, total)
                     if r["run"] != "#" else ["#"] for r in rows]
            yield pa.record_batch({"run": batch.column("run"), "words": pa.array(found, pa.list_(pa.string()))})

    return different.join(known, "run", "left").select("run", "known").mapInArrow(cut_up, "run string, words array<string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and score (log-odds to block; null where
    the URL has no words).

    Null URLs and URLs without ``://`` have neither host nor path; without a rule and
    without words a URL is allowed, and a tie of the odds is, too. Repeated rows are judged each. Columns other
    than page_id, url and html are not read; null html has no words. An empty table gives an empty frame.
    """
    host, path = host_and_path(F.col("url"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    # Words of a host and of a path are scored by what the runs look like, digits aside.
    rows = cut(pages.select("page_id", host.alias("host"), path.alias("path")).select(
        "*", rule.alias("rule"), by_rule.alias("by_rule"), F.array_join(runs(F.col("host")), " ").alias("h"),
        F.array_join(runs(F.col("path")), " ").alias("p")))
    shapes = cut(rows.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n")))
    parts = shapes.select(F.lit("h").alias("kind"), F.col("h").alias("part"), "n").union(
        shapes.select(F.lit("p"), F.col("p"), "n")).groupBy("kind", "part").agg(F.sum("n").alias("n"))
    each = cut(parts.select("kind", "part", F.posexplode(F.split("part", " ")).alias("nth", "run")).where("run <> ''"))
    cuts = cut(segment(each.select("run").distinct(), word_counts(pages, seeds)))
    # A word counts once for a host and once for a path, however often it stands there: a path that repeats
    # a word a thousand times must not outweigh all other URLs.
    tokens = cut(each.join(cuts, "run").select("kind", "part", F.explode("words").alias("word")).distinct())
    # A page is an example to block if its host or its path has a seed.
    seeded = tokens.groupBy("kind", "part").agg(F.max(F.col("word").isin(*seeds).cast("int")).alias("seed"))
    weighed = shapes
    for kind in "hp":
        weighed = weighed.join(cut(seeded.where(F.col("kind") == kind).select(
            F.col("part").alias(kind), F.col("seed").alias(f"seed_{kind}"))), kind, "left")
    bad = F.greatest(F.coalesce("seed_h", F.lit(0)), F.coalesce("seed_p", F.lit(0)))
    weighed = cut(weighed.select("h", "p", "n", (F.col("n") * bad).alias("bad")))
    by_part = weighed.select(F.lit("h").alias("kind"), F.col("h").alias("part"), "n", "bad").union(
        weighed.select(F.lit("p"), F.col("p"), "n", "bad")).groupBy("kind", "part").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counts = cut(tokens.join(cut(by_part), ["kind", "part"]).groupBy("kind", "word").agg(
        F.sum("bad").alias("bad"), F.sum(F.col("n") - F.col("bad")).alias("good")))
    n, bad_n = weighed.agg(F.sum("n"), F.sum("bad")).first()
    bad_words, good_words, v = counts.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    if not v:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(ALLOW)).alias("verdict"),
                           F.lit(None).cast("double").alias("score"))
    prior = math.log((bad_n + SMOOTHING) / (n - bad_n + SMOOTHING))
    shift = math.log((good_words + SMOOTHING * v) / (bad_words + SMOOTHING * v))
    odds = counts.select("kind", "word", (F.log((F.col("bad") + SMOOTHING) / (F.col("good") + SMOOTHING)) + shift).alias("odds"))
    scores = tokens.join(odds, ["kind", "word"]).groupBy("kind", "part").agg(F.sum("odds").alias("s"))
    scores = cut(scores)
    for kind in "hp":
        rows = rows.join(scores.where(F.col("kind") == kind).select(F.col("part").alias(kind), F.col("s").alias(f"score_{kind}")),
                         kind, "left")
    worded = F.col("score_h").isNotNull() | F.col("score_p").isNotNull()
    score = F.when(worded, F.coalesce("score_h", F.lit(0.0)) + F.coalesce("score_p", F.lit(0.0)) + prior)
    by_words = F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)
    return rows.withColumn("score", score).select("page_id", "host", "path", "rule",
                                                  F.coalesce("by_rule", by_words).alias("verdict"), "score")


def op1_url_filters(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page, as its contract names them."""
    return judge(pages)
