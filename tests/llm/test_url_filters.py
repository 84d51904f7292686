"""Rules, segmentation and the classifier against plain versions."""

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cargolens.llm import url_filters
from cargolens.llm.url_filters import ALLOW, BLOCK, RULES, SEEDS, judge, viterbi

SCHEMA = "page_id long, url string, html string, host long, rule string"


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), -i, h + p, v) for i, (v, h, p) in enumerate(RULES)
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, None))


URLS = ["http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.com/de/?x#y", "https://notexample.com/de/", "x://org/fr/",
        "x://org/fr", "http://net", "http://net/", "//none", "", None, "a://b://c/d", "http://h?q=/net/", "http://www.cheappills.org/shop/buy",
        "http://adult-x.example.org/en/4", "http://thing.example.org/en/4", "http://thing.example.org/en/4", "http://ÄÖ.org/ü", "http://a\nb.net/x\ny",
        "http://" + "longname" * 40 + ".org/" + "word/" * 2000]


def frame(spark, urls, html="<html><p>the thing word shop online</p><script>hidden</script></html>"):
    return spark.createDataFrame([(i, u, html if i % 4 else None, 1, "x") for i, u in enumerate(urls)], SCHEMA)


def test_contract_columns(spark):
    got = sorted(judge(frame(spark, URLS)).collect())
    assert len(got) == len(URLS)
    for r, u in zip(got, URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in (BLOCK, ALLOW)
    by = {u: r for u, r in zip(URLS, got)}
    assert by["http://www.cheappills.org/shop/buy"].verdict == BLOCK
    assert by["http://adult-x.example.org/en/4"].score > by["http://thing.example.org/en/4"].score
    assert by["http://thing.example.org/en/4"].verdict == by[""].verdict == by[None].verdict == ALLOW


def test_empty_table_and_no_words(spark):
    assert judge(frame(spark, [])).count() == 0
    assert [r.verdict for r in judge(frame(spark, [None, "", "://"])).collect()] == [ALLOW] * 3


@pytest.mark.parametrize("run", ["cheappills", "aab", "thethingword", "xyz", "a"])
def test_viterbi(run):
    counts, total = {"cheap": 50, "pills": 40, "the": 900, "thing": 60, "word": 30, "a": 500, "ab": 90, "thin": 5, "g": 1}, 2000
    known = {(i, n): counts[run[i:i + n]] for i in range(len(run)) for n in range(1, len(run) - i + 1) if run[i:i + n] in counts}

    def p(w):
        return math.log10(counts[w] / total) if w in counts else 1 - math.log10(total) - len(w)

    cuts = [[run[a:b] for a, b in itertools.pairwise((0, *c, len(run)))] for k in range(len(run)) for c in itertools.combinations(range(1, len(run)), k)]
    got = viterbi(run, known, total)
    assert "".join(got) == run and sum(map(p, got)) == pytest.approx(max(sum(map(p, c)) for c in cuts))


def test_runs_are_cut_alike_in_tables_of_any_size(spark):
    """Ten thousand times the same pages: every count grows alike, the seeds' too."""
    runs = spark.createDataFrame([(r,) for r in ("cheappillsonline", "freebetsword", "adserverthing", "thethingword", "sexpopup")], "run string")
    html = "the thing word shop online free se x pop up serve rs ad " * 40
    cuts = []
    for times in (1, 10_000):
        counts = url_filters.word_counts(frame(spark, ["http://a.org"] * 3, html))
        counts = counts.withColumn("n", F.when(F.col("word").isin(*SEEDS), F.col("n")).otherwise(F.col("n") * times))
        if times > 1:  # as word_counts sets the seeds for a table that large
            total = counts.where(~F.col("word").isin(*SEEDS)).agg(F.sum("n")).first()[0]
            counts = counts.withColumn("n", F.when(F.col("word").isin(*SEEDS), F.lit(math.ceil(total * url_filters.SEED_SHARE))).otherwise(F.col("n")))
        cuts.append({r.run: r.words for r in url_filters.segment(runs, counts).collect()})
    assert cuts[0] == cuts[1] and cuts[0]["cheappillsonline"] == ["cheap", "pills", "online"]


def test_scores_against_plain_bayes(spark):
    urls = [f"http://{h}.example.org/{p}/{i}" for i, (h, p) in enumerate(itertools.product(
        ["casino-win", "m.thing", "shop.word", "free-bets", "online"], ["en", "promo", "thing"]))] * 3
    got = sorted(judge(frame(spark, urls)).collect())
    # Every run here is a word of its own or splits into single words that the pages have.
    cut = url_filters.segment(spark.createDataFrame([(r,) for r in {w for u in urls for w in re.findall("[a-z]+", u)}], "run string"),
                              url_filters.word_counts(frame(spark, urls)))
    words = {r.run: r.words for r in cut.collect()} | {"#": ["#"]}
    pages = []
    for u in urls:
        _, _, host, path = re.match("(.*?)(//)([^/]*)(.*)", u).groups()
        pages.append({(k, w) for k, s in (("h", host), ("p", path)) for r in re.findall("[a-z]+|[0-9]+", s)
                      for w in words["#" if r.isdigit() else r]})
    bad = [any(w in SEEDS for _, w in t) for t in pages]
    count = {b: Counter(w for t, x in zip(pages, bad) if x == b for w in t) for b in (True, False)}
    v = len(count[True] | count[False])
    odds = {w: math.log((count[True][w] + 1) / (sum(count[True].values()) + v)) - math.log((count[False][w] + 1) / (sum(count[False].values()) + v))
            for w in count[True] | count[False]}
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    for r, t in zip(got, pages):
        assert r.score == pytest.approx(prior + sum(odds[w] for w in t))
        assert r.verdict == (BLOCK if r.score > 0 else ALLOW)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_hosts_with_seeds_are_blocked_and_others_are_not(spark, sf):
    got = judge(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")).where("rule is null").collect()
    seeded = [r for r in got if set(re.split("[^a-z]", r.host)) & set(SEEDS)]
    clean = [r for r in got if not set(re.split("[^a-z]", r.host)) & set(SEEDS)]
    assert seeded and {r.verdict for r in seeded} == {BLOCK}
    assert sum(r.verdict == BLOCK for r in clean) <= len(clean) // 50
