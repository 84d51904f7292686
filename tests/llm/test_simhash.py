"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cargolens.llm import components, simhash
from cargolens.llm.components import connected_components
from cargolens.llm.simhash import GrayTree, block_masks, forest, gray_rank

SCHEMA = "doc_id long, text string, lang string, fingerprint string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    """Smallest id reachable, by comparing all pairs of different fingerprints."""
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for (i, *_), f in zip(rows, fps):
        least.setdefault(find(f), []).append(i)
    return [(i, f"{f:016x}", min((x for x in least[find(f)] if x is not None), default=None))
            for (i, *_), f in zip(rows, fps)]


def check(spark, rows):
    got = simhash.op4_simhash(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_components(rows), key=key)


def test_odd_rows(spark):
    check(spark, [(5, None, None, None), (4, "", "en", "x"), (None, "a b c", "en", "x"), (None, "a b c", "en", "x"),
                  (9, "A  B\tc", None, "x"), (7, "one", "en", "x"), (7, "one", "en", "x"),
                  (8, "été ÉTÉ x y z " * 40_000, "fr", "x"), (1, "none like this", "en", "x")])
    only_null = [(None, "a b c d e", "en", "x")] * 3
    check(spark, only_null)
    empty = simhash.op4_simhash(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_near_copies(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(260):
        if i % 3:
            text = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(rnd.choice((0, 1, 1, 2))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        else:
            text = rnd.choices(words, k=rnd.choice((3, 30, 120, 240)))
        rows.append((i * 7 % 1000, " ".join(text), "en", "x"))
    check(spark, rows)


def cluster(n, seed=1, flips=14):
    rnd = np.random.default_rng(seed)
    centres = rnd.integers(0, 1 << 63, size=5, dtype=np.uint64)
    at = rnd.integers(0, 64, size=flips)
    x = centres[rnd.integers(0, 5, size=n)]
    for a in at:
        x = x ^ (rnd.integers(0, 2, size=n, dtype=np.uint64) << np.uint64(a))
    return np.unique(x)


def labels(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("n,flips", [(40, 30), (700, 12), (1500, 40), (900, 24)])
def test_forest_joins_what_all_pairs_join(n, flips):
    x = cluster(n, flips=flips)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    u, v = forest(x)
    assert (np.bitwise_count(u ^ v) <= 4).all() and len(u) < len(x)
    place = {k: i for i, k in enumerate(x.tolist())}
    mine = [(place[a], place[b]) for a, b in zip(u.tolist(), v.tolist())]
    assert labels(len(x), mine) == labels(len(x), near.tolist())


def test_tree_prunes_groups():
    x = np.unique(np.random.default_rng(3).integers(0, 1 << 63, size=4000, dtype=np.uint64) & np.uint64(0xFFFFF))
    x = x[np.argsort(gray_rank(x))]
    tree = GrayTree(x)
    who, member = tree.search(np.arange(50), 4, np.arange(len(x)))
    want = [(i, j) for i in range(50) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 4]
    assert sorted(zip(who.tolist(), member.tolist())) == want
    assert sorted(gray_rank(np.arange(64, dtype=np.uint64)).tolist()) == list(range(64))


def test_large_nodes_are_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_NODE", 20)
    x = cluster(600, flips=18)
    df = spark.createDataFrame([(int(v) - (1 << 64) if v >> 63 else int(v),) for v in x.tolist()], "fp long")
    place = {r: i for i, r in enumerate(sorted(r.fp for r in df.collect()))}
    y = np.array(sorted(place), dtype=np.int64).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(y[:, None] ^ y[None, :]) <= 4, 1)).tolist()
    mine = [(place[r.u], place[r.v]) for r in simhash.links(df).collect()]
    assert labels(len(y), mine) == labels(len(y), near)


def test_masks_cover_all_small_differences():
    rnd = random.Random(2)
    masks = block_masks((1 << 64) - 1)
    assert len(masks) == 15
    for _ in range(300):
        differ = sum({1 << rnd.randrange(64) for _ in range(4)})
        assert any(not differ & m for m in masks)


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rnd.randrange(300)) for _ in range(300)] + [(5000, 5000), (7, None)]
    df = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:50]], "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert len({got[i] for i in range(201)}) == 1
    assert len({got[a] for a in got if 1000 <= a < 1300}) == 1
    assert len(set(got.values())) == 2 and 5000 not in got
    assert connected_components(df.limit(0)).count() == 0


def test_component_plans_do_not_grow_with_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", 0, raising=False)
    rounds, hooks = [], components._hooks
    monkeypatch.setattr(components, "_hooks", lambda edges, n: rounds.append(n) or hooks(edges, n))
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000) if i % 1000] + [(-5, i) for i in range(2000, 2600)], "u long, v long")
    found = connected_components(edges)
    assert len(rounds) > 3 and found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    root = {r.node: r.root for r in found.collect()}
    assert len({root[i] for i in range(1, 1001)}) == len({root[i] for i in [-5, *range(2001, 3001)]}) == 1
    assert sorted(root) == [-5, *range(1, 3001)] and len(set(root.values())) == 2


def test_few_edges_take_no_rounds(spark, monkeypatch):
    cuts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(df) or cut(df))
    pairs = [(i, i + 1) for i in range(0, 900) if i % 100 != 50] + [(-(1 << 63), 899), ((1 << 63) - 1, 0)]
    root = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    assert len(cuts) == 1 and len(root) == 903 and len(set(root.values())) == 10
    assert root[0] == root[(1 << 63) - 1] == 0 and root[899] == root[-(1 << 63)] and root[51] == root[150] != root[50]


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text, "en", "b"), (2, text, "en", "b"), (2, text, "en", "b"), (2, text, "en", "a"), (None, text, "en", "a"),
            (None, "other words here now ok", "en", "z"), (None, "other words here now ok", "en", "z"), (9, "alone", None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and sorted(str(r.doc_id) for r in got) == ["2", "9", "None"]


def test_keep_one_runs_no_rounds_for_few_links(spark, monkeypatch):
    written = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(df.columns) or cut(df))
    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([f"other{j}" if j % 25 == 0 and j < 25 * i else w for j, w in enumerate(words)]), "en", "b") for i in range(12)]
    want = {component for *_, component in plain_components(rows)}
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < 12
    assert len(written) <= 8
