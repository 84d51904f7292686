"""Language-model scores by a weighted backoff automaton.

Training counts every n-gram of the training documents; scoring walks each
text once, left to right, through an automaton whose states are the contexts
seen in training. An arc (state, word) has the smoothed probability of that
word in that context; a state without an arc for the word is left by its failure arc,
which costs the context's backoff weight and leads to the context without its first
word. The empty context has an arc for every word.

No task holds the whole model. Documents are first put together to shards of
some hundred thousand tokens. A shard asks for the n-grams it has itself: it sends
their sorted 64-bit keys with its own training counts, cut by key range, to the
tasks that add up the counts of one range over all shards, and gets the totals
back in the same order. So what moves is a few bytes for each different n-gram of
a shard, a frequent one is added up before it moves, and each shard builds its
part of the automaton from complete counts. The rounds go from the longest n-grams to
single words, because a context's backoff weight needs the number of different words
that follow it: a shard counts those for which it is the first shard that has them.

Smoothing: interpolated absolute discounting down to single words, and
add-0.1 for those, so the probabilities after any context sum to one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder

ORDER = 3
DISCOUNT = 0.75
ADD = 0.1
HELD_OUT_MODULUS = 10
SHARD_TOKENS = 800_000
#: Entries of one key range over all shards, about.
RANGE_ENTRIES = 2_000_000
#: Tokens that a walk takes in one piece; all pieces of a shard walk side by side.
PIECE = 512
#: Keys of the text's end, a token, and of its begin, a context only.
END, BEGIN = 0, 1
#: Upper bits of the keys of n-grams of more than one word.
GRAM_BITS = 0xFFFFFFFFFFFFFF00


# ---------------------------------------------------------------- arrays --

def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small ones take little room."""
    planes = np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return planes.reshape(8, -1).T.copy().view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Unsigned keys as differences, which are small where the keys rise."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).view(np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def different(keys: np.ndarray, numbered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The different keys in rising order, a place of each and, if ``numbered``, which of them stands at each place. As
    np.unique, but of equal keys any may give the place, so the sort need not be stable."""
    by_key = np.argsort(keys)
    rising = keys[by_key]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = rising[1:] != rising[:-1]
    which = None
    if numbered:
        which = np.empty(len(keys), dtype=np.int64)
        which[by_key] = np.cumsum(new) - 1
    return rising[new], by_key[new], which


# ---------------------------------------------------------------- shards --

def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only


def word_key(word: bytes) -> int:
    """64-bit key of a word; words whose keys collide would count as one."""
    return max(xxhash.xxh64_intdigest(word), 2)


def make_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text as binary) -> one row for each shard."""
    part, number = TaskContext.get().partitionId(), count()

    def shard() -> pa.RecordBatch:
        keys = np.array([END, *(word_key(w) for w in index)], dtype=np.uint64)
        flat = np.fromiter(chain.from_iterable(tokens), np.int64, sum(map(len, tokens)))
        # Numbered by falling count, then by key: common words have small numbers and keys come in
        # rising runs, and both pack well.
        by_count = np.lexsort((keys, -np.bincount(flat, minlength=len(keys))))
        rank = np.empty_like(by_count)
        rank[by_count] = np.arange(len(by_count))
        keys, flat = keys[by_count], rank[flat]
        return pa.record_batch({
            "shard": [(part << 32) + next(number)], "doc_id": pa.array([ids], pa.list_(doc_id_type)),
            "held_out": pa.array([held], pa.list_(pa.bool_())),
            "sizes": pa.array([list(map(len, tokens))], pa.list_(pa.int64())),
            "tokens": [pack(flat)], "vocabulary": [pack_keys(keys)], "n": [len(flat)]})

    def empty():
        index = defaultdict(count(1).__next__)
        return [], [], [], index

    ids, held, tokens, index = empty()
    seen = 0
    for batch in batches:
        doc_id_type = batch.schema.field("doc_id").type
        for doc_id, out, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text"))):
            ids.append(doc_id.as_py())
            held.append(out.as_py())
            tokens.append([*map(index.__getitem__, words(text.as_py())), 0])
            seen += len(tokens[-1])
            if seen >= SHARD_TOKENS:
                yield shard()
                ids, held, tokens, index = empty()
                seen = 0
    if ids:
        yield shard()


class Grams:
    """The n-grams of a shard by level: sorted keys, where each begins, which one ends at each place.

    A text is laid out as its begin followed by its tokens; ``key[k]`` has the
    different n-grams of k symbols, ``at[k]`` the number of the one that ends
    at each place (-1: none), ``place[k]`` a place where each ends. Of the levels
    in ``above`` there are only ``key`` and ``place``.
    """

    def __init__(self, row: dict, levels: set[int], above: set[int] = frozenset()):
        sizes = np.array(row["sizes"], dtype=np.int64)
        vocabulary, tokens = unpack_keys(row["vocabulary"]), unpack(row["tokens"])
        first = np.cumsum(sizes + 1) - sizes - 1
        is_token = np.ones(len(tokens) + len(sizes), dtype=bool)
        is_token[first] = False
        symbol = np.full(len(is_token), BEGIN, dtype=np.uint64)
        symbol[is_token] = vocabulary[tokens]
        depth = np.arange(len(symbol)) - np.repeat(first, sizes + 1)
        self.sizes, self.first, self.is_token = sizes, first, is_token
        self.train = np.repeat(~np.array(row["held_out"], dtype=bool), sizes + 1)
        self.key, self.at, self.place = {}, {}, {}
        now = symbol
        for k in range(1, max(levels | above) + 1):
            if k > 1:
                before = np.append(np.uint64(0), now[:-1])
                now = mix(before * np.uint64(0x9E3779B97F4A7C15) + symbol + np.uint64(k))
            if k == 1 and k in levels:
                # Words are numbered already, by the vocabulary, of which each occurs.
                self.key[1], _, number = different(np.append(vocabulary, np.uint64(BEGIN)))
                self.at[1] = np.full(len(symbol), number[-1])
                self.at[1][is_token] = number[tokens]
                self.place[1] = np.empty(len(self.key[1]), dtype=np.int64)
                self.place[1][self.at[1]] = np.arange(len(symbol))
            elif k in levels or k in above:
                there = np.flatnonzero(depth >= k - 1)
                # n-grams of several words are known by 56 bits, words by 64.
                self.key[k], place, which = different(now[there] & np.uint64(GRAM_BITS), k in levels)
                self.place[k] = there[place]
                if k in levels:
                    self.at[k] = np.full(len(symbol), -1)
                    self.at[k][there] = which

    def counts(self, k: int) -> np.ndarray:
        """Training occurrences of each n-gram in this shard."""
        at = self.at[k][self.train]
        return np.bincount(at[at >= 0], minlength=len(self.key[k]))

    def context(self, k: int) -> np.ndarray:
        """Number, a level below, of the n-gram without its last symbol."""
        return self.at[k - 1][self.place[k] - 1]


# ---------------------------------------------------------------- counts --

def answers(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total count, different followers, whether this shard has it first) of each n-gram of level k."""
    parts = sorted(row[f"answer{k}"] or [], key=lambda p: p["range"])  # texts without words have no long n-grams
    none = np.zeros(0, dtype=np.int64)
    total, follow, first = (np.concatenate([none, *(unpack(p[c]) for p in parts)]) for c in ("total", "follow", "first"))
    return total, follow, first.astype(bool)


def ask(k: int, order: int, bits: int):
    """Rows of a shard's n-grams of level k, cut by key range."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(row, {k}, set() if k == order else {k + 1})
                follow = np.zeros(len(grams.key[k]), dtype=np.int64)
                if k < order:
                    total, _, first = answers(row, k + 1)
                    follow = np.bincount(grams.context(k + 1)[first & (total > 0)], minlength=len(follow))
                counts = grams.counts(k)
                number = grams.key[k] >> np.uint64(64 - bits) if bits else np.zeros(len(counts), dtype=np.uint64)
                ranges, start = np.unique(number, return_index=True)
                for r, a, b in zip(ranges.tolist(), start, np.append(start[1:], len(counts))):
                    yield pa.record_batch({"range": [r], "shard": [row["shard"]],
                                           "keys": [pack_keys(grams.key[k][a:b])], "counts": [pack(counts[a:b])],
                                           "follow": [pack(follow[a:b])]})
    return cut_up


def add_up(asked: pa.Table) -> pa.Table:
    """Totals of one key range, for each shard that asked; n and v: tokens and different tokens in it."""
    asked = asked.sort_by("shard")
    keys = [unpack_keys(x) for x in asked.column("keys").to_pylist()]
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    key, first, inverse = different(np.concatenate(keys))
    totals = []
    for c in ("counts", "follow"):
        own = np.concatenate([unpack(x) for x in asked.column(c).to_pylist()])
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, inverse, own)
        totals.append(total)
    has_first = np.zeros(len(inverse), dtype=np.int64)
    has_first[first] = 1
    word = key != BEGIN
    return pa.table({
        "shard": asked.column("shard"), "range": asked.column("range"),
        "total": [pack(x) for x in np.split(totals[0][inverse], cuts)],
        "follow": [pack(x) for x in np.split(totals[1][inverse], cuts)],
        "first": [pack(x) for x in np.split(has_first, cuts)],
        "n": [int(totals[0][word].sum())] + [0] * (asked.num_rows - 1),
        "v": [int((totals[0][word] > 0).sum())] + [0] * (asked.num_rows - 1)})


# -------------------------------------------------------------- the walk --

class Automaton:
    """A shard's part of the automaton, from complete counts.

    A state whose context has d words is only ever in at a place that these words precede, so its arc for the word there, if
    there is one, is that of the n-gram of d + 1 words that ends at the place: it is looked up by place and d.
    """

    def __init__(self, grams: Grams, found: dict[int, tuple], order: int, n: int, v: int):
        state, base, made = {}, 1, 0  # of each n-gram that is a context; state 0 has no words
        self.fail, self.backoff, self.depth = [np.zeros(1, dtype=np.int64)], [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        arcs, weights, targets = [], [], []
        lower = None
        for k in range(1, order + 1):
            total, follow, _ = found[k]
            known = total > 0
            suffix = grams.at[k - 1][grams.place[k]] if k > 1 else None  # without its first symbol
            if k == 1:
                p = (total + ADD) / (n + ADD * (v + 1))
                arc = np.ones(len(total), dtype=bool)
            else:
                context = grams.context(k)
                above, spread = found[k - 1][0][context], found[k - 1][1][context]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(known, (total - DISCOUNT + DISCOUNT * spread * lower[suffix]) / above, np.nan)
                arc = known
            if k < order:
                state[k] = np.where(known, base + np.cumsum(known) - 1, 0)
                base += int(known.sum())
                self.depth.append(np.full(int(known.sum()), k))
                self.fail.append(state[k - 1][suffix[known]] if k > 1 else np.zeros(int(known.sum()), dtype=np.int64))
                # A context without followers is only ever left: its words are a text's last.
                spread = np.where(follow > 0, DISCOUNT * follow, 1) / np.where(follow > 0, total, 1)
                self.backoff.append(np.log10(spread[known]))
                target = state[k]
            else:
                target = state[k - 1][suffix]
            # The last entry is for places where no n-gram of k words ends.
            arcs.append(np.append(np.where(arc, made + np.cumsum(arc) - 1, -1), -1)[grams.at[k]])
            made += int(arc.sum())
            weights.append(np.log10(p[arc]))
            targets.append(target[arc].astype(np.int32))
            lower = p
        self.begin = int(state[1][np.searchsorted(grams.key[1], np.uint64(BEGIN))]) if order > 1 else 0
        self.fail, self.backoff, self.depth = np.concatenate(self.fail), np.concatenate(self.backoff), np.concatenate(self.depth)
        self.arc, self.weight, self.target = np.stack(arcs), np.concatenate(weights), np.concatenate(targets)

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read the word at a place in each state: (log10 probability, next state)."""
        cost, state = np.zeros(len(state)), state.copy()
        left = np.arange(len(state))
        while len(left):
            arc = self.arc[self.depth[state[left]], place[left]]
            hit = arc >= 0
            cost[left[hit]] += self.weight[arc[hit]]
            state[left[hit]] = self.target[arc[hit]]
            left = left[~hit]
            cost[left] += self.backoff[state[left]]
            state[left] = self.fail[state[left]]
        return cost, state


def walk(grams: Grams, automaton: Automaton, order: int) -> np.ndarray:
    """log10 probability of each text. Long texts walk in pieces side by side: a
    state is the longest known suffix of the last order - 1 symbols, so reading those
    first puts a piece into the state in which the piece before it ends."""
    pieces = -(-grams.sizes // PIECE)
    text = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = grams.first[text] + 1 + nth * PIECE
    size = np.minimum(PIECE, grams.sizes[text] - nth * PIECE)
    by_size = np.argsort(-size, kind="stable")
    text, nth, start, size = text[by_size], nth[by_size], start[by_size], size[by_size]
    state = np.where(nth == 0, automaton.begin, 0)
    later = np.flatnonzero(nth > 0)
    for back in range(order - 1, 0, -1):
        state[later] = automaton.step(state[later], start[later] - back)[1]
    score = np.zeros(len(text))
    for i in range(int(size[0]) if len(size) else 0):
        live = np.searchsorted(-size, -i, side="left")
        cost, state[:live] = automaton.step(state[:live], start[:live] + i)
        score[:live] += cost
    return np.bincount(text, weights=score, minlength=len(pieces))


def score_shards(order: int, n: int, v: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(row, set(range(1, order + 1)))
                found = {k: answers(row, k) for k in range(1, order + 1)}
                total = found[1][0][grams.at[1][grams.is_token]]
                text = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
                base = np.log10((total + ADD) / (n + ADD * (v + 1)))
                per_text = lambda w: np.bincount(text, weights=w, minlength=len(grams.sizes))
                yield pa.record_batch({
                    "doc_id": pa.array(row["doc_id"], batch.schema.field("doc_id").type.value_type),
                    "held_out": pa.array(row["held_out"]), "n_tokens": pa.array(grams.sizes),
                    "n_known": pa.array(per_text(total > 0).astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(grams.sizes), n, dtype=np.int64)),
                    "base_score": pa.array(per_text(base)),
                    "score": pa.array(walk(grams, Automaton(grams, found, order, n, v), order))})
    return scored


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
                    held_out_modulus: int = HELD_OUT_MODULUS) -> DataFrame:
    """Every text's log10 probability under the model learned from the texts that are not held out.

    Returns doc_id, held_out (crc32 of the id as text is divisible by
    ``held_out_modulus``), n_tokens (words and one end), n_known (of these, seen in training),
    train_tokens, base_score (single words only, add-0.1) and score. A null or empty text is its
    end alone; a null id counts as ''; repeated rows are scored, and counted in
    training, each; a text that has only unknown words falls back to the
    empty context throughout. Without any training text every score comes from the
    add-0.1 rule with no counts. An empty table gives an empty frame; other
    columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       (id_remainder(F.col(doc_id), held_out_modulus) == 0).alias("held_out"),
                       F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shards = cut(rows.mapInArrow(make_shards, f"shard long, doc_id array<{kind}>, held_out array<boolean>, "
                                 "sizes array<long>, tokens binary, vocabulary binary, n long"))
    tokens = shards.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens / RANGE_ENTRIES)))))
    n = v = 0
    answered = {}
    for k in range(order, 0, -1):
        known = shards.join(answered[k + 1], "shard", "left") if k < order else shards
        asked = known.mapInArrow(ask(k, order, bits), "range long, shard long, keys binary, counts binary, follow binary")
        totals = cut(asked.groupBy("range").applyInArrow(
            add_up, "shard long, range long, total binary, follow binary, first binary, n long, v long"))
        if k == 1:
            n, v = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())
        answered[k] = totals.groupBy("shard").agg(
            F.collect_list(F.struct("range", "total", "follow", "first")).alias(f"answer{k}"))
    known = shards
    for by_shard in answered.values():
        known = known.join(by_shard, "shard", "left")
    return known.mapInArrow(score_shards(order, n, v), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                            "train_tokens long, base_score double, score double")


def op10_lm(docs: DataFrame) -> DataFrame:
    """Scores of every document, as its contract names them."""
    return score_documents(docs)
