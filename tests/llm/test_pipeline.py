"""The pipeline against a plain version of its stages, written from their descriptions."""

import hashlib
import re
from collections import defaultdict

import pytest
import tiktoken
from test_simhash import plain_components

import corpus_pipeline
import public_tokenizers
from cargolens.llm import bpe, mixing, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_mix(rows, *only):
    """Rows of (doc_id, source, text) -> the mix (of some sources), by clamping and sharing until no source is above its cap."""
    size = {s: sum(len(WORD.findall(t)) for _, q, t in rows if q == s) for s in {r[1] for r in rows}}
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in above} or share
        open_ = open_ - above if above else set()
    out = []
    for s in only or order:
        here = sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}|{'' if r[0] is None else r[0]}".encode()).hexdigest())
        copies = int(target[s] // size[s]) if size[s] else 0
        left = int(target[s] - copies * size[s] + 0.5)  # halves go up
        for i, _, t in here:
            words = len(WORD.findall(t))
            # Texts stay whole: the last one is taken once more if half of it or more is asked for.
            out += [(i, t)] * (copies + (words > 0 and 2 * max(0, left) >= words) if words else 0)
            left -= words
    return out


def test_run(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect() if model.score(r.text.encode()) < 0.7]
    assert 0 < len(rows) < docs.count()
    component = {i: c for i, _, c in plain_components([(r[0], r[2]) for r in rows])}
    rows = [r for r in rows if component[r[0]] == r[0]]
    mixed = plain_mix(rows)
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in mixed:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r[0], *r[3:]) for r in got.collect()) == sorted(want)


def test_stages_keep_columns_and_empty_tables(spark, docs):
    odd = docs.limit(0)
    more = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, more):
            out = stage(spark, frame, SF)
            assert out.count() <= 3
            if name != "bpe":
                assert out.columns == docs.columns
    clashing = docs.withColumnsRenamed({"lang": "row", "n_chars": "m_row"}).withColumn("encoded", docs.source)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns and out.count() > 0
    assert bpe.encode_texts(clashing).columns[:6] == clashing.columns
    groups = defaultdict(int)
    for r in corpus_pipeline.drop_near_duplicates(spark, more, SF).collect():
        groups[r.doc_id] += 1
    assert dict(groups) == {1: 1}
