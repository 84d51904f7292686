"""SimHash near duplicates through a Gray-order hierarchical index.

Fingerprints are cut to distinct values first. A link is at most four
differing bits, so of six blocks of bits two at least agree: the index's upper
nodes are the masked bit patterns of each two blocks (15 masks), and Spark deals
the fingerprints out by (mask, pattern). Within such a node the fingerprints are
sorted by Gray rank, and groups of neighbours are factored into lower nodes
that keep the bits all their members share. A search walks down with the
differences accumulated so far and drops a whole group once they exceed the
distance; it also drops groups that already belong to the searcher's own
component. A node that holds very many fingerprints is dealt out again by the
patterns of two of six blocks of its remaining bits, which loses no link. Each
node emits a spanning forest of its links; Spark joins them into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, one_of_each, row_hashes, spare_names
from .components import connected_components

#: The contract: words in a shingle, and bits in which linked fingerprints differ at most.
SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 6
#: Fingerprints of one pattern from which on it is dealt out again.
LARGE_NODE = 4096
#: Members of a leaf, and children of an inner node, of the tree in a node.
LEAF, FAN = 16, 8
HASHES_AT_A_TIME = 65_536


# ---------------------------------------------------------- fingerprints --

def simhash(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, HASHES_AT_A_TIME):
        spans = zip(starts[i:i + HASHES_AT_A_TIME].tolist(), ends[i:i + HASHES_AT_A_TIME].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """SimHash of a text column as a long (its bits as two's complement)."""
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return fingerprints(text.cast("binary"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------- the index --

def block_masks(bits: int, blocks: int = BLOCKS, agree: int = BLOCKS - MAX_BITS) -> list[int]:
    """Masks of each ``agree`` of ``blocks`` blocks, into which the bits set in ``bits`` are cut."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = [sum(1 << i for i in places[len(places) * k // blocks:len(places) * (k + 1) // blocks])
            for k in range(blocks)]
    return [sum(c) for c in combinations(cuts, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayTree:
    """Groups of Gray-ordered fingerprints, each with the bits its members share."""

    def __init__(self, x: np.ndarray):
        self.x, self.levels = x, []  # from the leaves up: starts, ends, shared mask, pattern
        starts = np.arange(0, len(x), LEAF)
        ones, zeros = np.bitwise_and.reduceat(x, starts), np.bitwise_and.reduceat(~x, starts)
        ends = np.append(starts[1:], len(x))
        while True:
            self.levels.append((starts, ends, ones | zeros, ones))
            if len(starts) <= FAN:
                break
            first = np.arange(0, len(starts), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            starts, ends = starts[first], ends[np.append(first[1:], len(starts)) - 1]
        # A node keeps only the bits that its parent does not have yet.
        self.own = []
        for k, (_, _, mask, _) in enumerate(self.levels):
            above = self.levels[k + 1][2] if k + 1 < len(self.levels) else None
            self.own.append(mask if above is None else mask & ~above[np.arange(len(mask)) // FAN])

    def search(self, q: np.ndarray, most: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searcher, member) of each pair within ``most`` bits, the member later
        in the order and of another component by ``label``."""
        top = len(self.levels) - 1
        who = np.repeat(q, len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(q))
        apart = np.zeros(len(who), dtype=np.int64)
        for k in range(top, -1, -1):
            starts, ends, _, pattern = self.levels[k]
            low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            other = (low[node] != high[node]) | (low[node] != label[who])
            keep = (ends[node] - 1 > who) & other
            who, node, apart = who[keep], node[keep], apart[keep]
            apart = apart + np.bitwise_count((self.x[who] ^ pattern[node]) & self.own[k][node])
            keep = apart <= most
            who, node, apart = who[keep], node[keep], apart[keep]
            if k:
                last = np.minimum((node + 1) * FAN, len(self.levels[k - 1][0]))
                size = last - node * FAN
                child = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                who, apart = np.repeat(who, size), np.repeat(apart, size)
                node = np.repeat(node * FAN, size) + child
        starts, ends = self.levels[0][:2]
        size = ends[node] - starts[node]
        member = np.repeat(starts[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        who = np.repeat(who, size)
        near = (member > who) & (np.bitwise_count(self.x[who] ^ self.x[member]) <= most) & (label[who] != label[member])
        return who[near], member[near]


def forest(x: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within ``most`` bits do;
    fewer of them than fingerprints. Arrays of the two ends."""
    x = x[np.argsort(gray_rank(x), kind="stable")]
    tree, label = GrayTree(x), np.arange(len(x))
    left, right = [], []
    step = int(np.clip(2_000_000 // len(x), 1, 512))
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while parent.get(a, a) != a:
            parent[a] = parent.get(parent[a], parent[a])
            a = parent[a]
        return a

    for i in range(0, len(x), step):
        who, member = tree.search(np.arange(i, min(i + step, len(x))), most, label)
        if not len(who):
            continue
        # One link for each searcher and component is enough.
        _, first = np.unique(who * len(x) + label[member], return_index=True)
        for a, b in zip(who[first].tolist(), member[first].tolist()):
            ra, rb = find(int(label[a])), find(int(label[b]))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
        changed = np.unique(label)
        to = np.array([find(c) for c in changed.tolist()])
        label = to[np.searchsorted(changed, label)]
    return x[np.array(left, dtype=np.int64)], x[np.array(right, dtype=np.int64)]


def small_links(node: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``most`` bits of neighbours with the same node number; nodes are contiguous and small."""
    left, right, d = [], [], 1
    while d < len(x) and (same := node[:-d] == node[d:]).any():
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(x[at] ^ x[at + d]) <= most]
        left.append(x[at])
        right.append(x[at + d])
        d += 1
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def node_links(mask: np.ndarray, pattern: np.ndarray, x: np.ndarray, most: int) -> pa.RecordBatch:
    """Links inside each (mask, pattern); rows come sorted by both."""
    new = np.append(True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
    node = np.cumsum(new) - 1
    size = np.bincount(node)
    parts = [small_links(node[k], x[k], most) for k in [(size[node] > 1) & (size[node] <= 2 * LEAF)]]
    for n in np.flatnonzero(size > 2 * LEAF):
        a, b = np.searchsorted(node, [n, n + 1])
        parts.append(forest(x[a:b], most))
    return pa.record_batch({c: np.concatenate([p[i] for p in parts]).view(np.int64) for i, c in enumerate("uv")})


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that join distinct fingerprints ``fp`` just as all pairs
    within ``max_bits`` bits do. With fewer blocks than bits to differ none would agree:
    ``max_bits`` is 4 at most."""
    if max_bits >= BLOCKS:
        raise ValueError(f"max_bits must be below {BLOCKS}")
    first = block_masks((1 << 64) - 1)
    entries = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in first])).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"))
    key = ["mask", "pattern"]
    large = cut(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_NODE).select(*key))
    if not large.isEmpty():
        again = F.create_map(*[x for m in first for x in (
            F.lit(signed(m)), F.array(*[F.lit(signed(m | s)) for s in block_masks(~m & ((1 << 64) - 1))]))])
        finer = entries.join(large, key, "left_semi").select("fp", F.explode(again[F.col("mask")]).alias("mask"))
        entries = entries.join(large, key, "left_anti").unionByName(
            finer.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a node may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, pattern, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", "fp"))
            x = x.view(np.uint64)
            if held is not None:
                mask, pattern, x = (np.concatenate(p) for p in zip(held, (mask, pattern, x)))
            open_ = (mask == mask[-1]) & (pattern == pattern[-1])
            held = mask[open_], pattern[open_], x[open_]
            if not open_.all():
                yield node_links(mask[~open_], pattern[~open_], x[~open_], max_bits)
        if held is not None:
            yield node_links(*held, max_bits)

    return entries.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "u long, v long")


# ------------------------------------------------------------ components --

def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = (),
                    width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: its id, the columns of ``also``,
    ``fingerprint`` (16 hex digits), ``component_id`` and ``component`` (a long of no meaning).

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` bits, the row's own included. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows share their
    fingerprint; a null id counts as larger than any other, and a component of
    null ids only has a null id. An empty table gives an empty frame; other
    columns of ``docs`` are not read.
    """
    ids = cut(docs.select(F.col(doc_id), *also, fingerprint(F.col(text), width).alias("fp")))
    least = cut(ids.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = connected_components(links(least.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    placed = cut(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component")))
    smallest = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    known = cut(placed.select("fp", "component").join(smallest, "component"))
    return ids.join(known, "fp").select(doc_id, *also, hex16(F.col("fp")).alias("fingerprint"),
                                        "component_id", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest
    id (null last; of rows with the same id, that of the smallest row hash).
    Columns stay as they are; an empty table stays empty."""
    row = spare_names(docs, "row", "twin")
    marked = docs.withColumns(dict(zip(row, row_hashes(docs))))
    found = near_duplicates(marked, doc_id, text, tuple(row), width, max_bits)
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), *row))
    chosen = cut(found.groupBy("component").agg(first.alias("first")).select(*[f"first.{c}" for c in row]))
    return one_of_each(marked, row).join(chosen, row, "left_semi").select("kept.*")


def op4_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document, as its contract names them."""
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
