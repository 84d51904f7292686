"""Byte-level BPE encoding and decoding by recursive queries in DuckDB.

Spark deals the documents out; inside each task the distinct pieces of the
pattern (not the texts) go to an in-memory DuckDB in blocks. There every
piece is a run of (piece, position, token, next token) rows. A recursive query
joins the rows with the merge table, contracts each piece's leftmost pair of
minimum rank and stops at the fixpoint; ordered aggregation writes down the
ids and decodes them back into bytes. A document's ids are those of its pieces
in order, so a task's memory is one Arrow batch of texts and a bounded cache
of pieces.

A text is first cut at every space that follows a non-space character. No
match of the pattern crosses such a cut, so the same unit always gives the
same ids wherever it stands; the pattern runs once per distinct unit.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare_names, worker_local


RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that one recursive query takes; units whose ids a worker remembers (some 200 bytes each); characters of text taken at a time.
PIECES_PER_QUERY = 20_000
#: The recursive query keeps the rows of every round, n * n / 2 for a piece of n bytes: its pieces have up to so many bytes, and a
#: query up to so many rows. Longer pieces go through the rounds one by one.
LONG_PIECE, ROWS_PER_QUERY = 256, 2_000_000
CACHED_UNITS = 800_000
BLOCK_CHARS = 2_000_000

#: Columns added, with their Spark and Arrow types.
DIGESTS = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
           "decoded_sha256": ("string", pa.string())}
IDS = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary())}

#: A pair's rank and its position share one integer, so that one min() finds the leftmost pair of minimum rank.
ENCODE = """
WITH RECURSIVE step(piece, pos, token, follower, done) AS (
    SELECT piece, pos, token, follower, false FROM symbols
  UNION ALL
    SELECT piece,
           CASE WHEN pos > spot THEN pos - 1 ELSE pos END,
           CASE WHEN pos = spot + 1 THEN merged ELSE token END,
           CASE WHEN pos = spot - 1 THEN merged ELSE follower END,
           spot IS NULL
    FROM (SELECT s.*, (b.best // 4294967296)::INT AS merged, (b.best % 4294967296)::INT AS spot
          FROM step s LEFT JOIN (
              SELECT s.piece, min(m.merged * 4294967296 + s.pos) AS best
              FROM step s JOIN merges m ON m.pair = s.token::BIGINT * 1048576 + s.follower
              WHERE NOT s.done GROUP BY s.piece) b ON b.piece = s.piece
          WHERE NOT s.done)
    WHERE spot IS NULL OR pos <> spot
)
SELECT string_agg(token::VARCHAR, ',') AS ids, unhex(string_agg(hex, '')) AS raw
FROM (SELECT piece, token, v.hex FROM step JOIN vocabulary v ON v.id = token WHERE done ORDER BY piece, pos)
GROUP BY piece ORDER BY piece
"""

WRITTEN = ENCODE[ENCODE.index("SELECT string_agg"):].replace("FROM step", "FROM {rows}").replace("WHERE done ", "")

#: One round over the symbols of long pieces: each piece's pairs of minimum rank are contracted from the left wherever they
#: stand, of overlapping ones the first, up to the first that makes a pair of lower rank with its neighbours, which
#: comes next. That is what contracting the leftmost pair of minimum rank, one at a time, comes to.
ROUND = """
CREATE OR REPLACE TABLE chosen AS
WITH found AS (
    SELECT s.piece, s.nth, s.before, s.after, m.merged
    FROM numbered s JOIN merges m ON m.pair = s.token::BIGINT * 1048576 + s.follower
    QUALIFY m.merged = min(m.merged) OVER (PARTITION BY s.piece)),
runs AS (SELECT *, nth - row_number() OVER (PARTITION BY piece ORDER BY nth) AS run FROM found),
picked AS (SELECT * FROM runs QUALIFY (nth - min(nth) OVER (PARTITION BY piece, run)) % 2 = 0),
sided AS (
    SELECT *, CASE WHEN lag(nth) OVER (PARTITION BY piece ORDER BY nth) = nth - 2 THEN merged ELSE before END AS l FROM picked),
falling AS (
    SELECT p.piece, min(p.nth) AS nth
    FROM (SELECT piece, nth, merged, l * 1048576 + merged AS pair FROM sided WHERE l >= 0
          UNION ALL SELECT piece, nth, merged, merged * 1048576 + after FROM sided WHERE after >= 0) p
         JOIN merges m ON m.pair = p.pair AND m.merged < p.merged
    GROUP BY p.piece)
SELECT p.piece, p.nth, p.merged FROM picked p LEFT JOIN falling f ON f.piece = p.piece WHERE f.nth IS NULL OR p.nth <= f.nth
"""
CONTRACT = """
CREATE OR REPLACE TABLE symbols AS
SELECT s.piece, s.pos, coalesce(c.merged, s.token)::INT AS token
FROM numbered s LEFT JOIN chosen c ON c.piece = s.piece AND c.nth = s.nth
     LEFT JOIN chosen p ON p.piece = s.piece AND p.nth + 1 = s.nth
WHERE p.piece IS NULL
"""
NUMBER = """
CREATE OR REPLACE TABLE numbered AS
SELECT piece, pos, token, coalesce(lead(token) OVER w, -1) AS follower, coalesce(lag(token) OVER w, -1)::BIGINT AS before,
       coalesce(lead(token, 2) OVER w, -1) AS after, row_number() OVER w AS nth
FROM symbols WINDOW w AS (PARTITION BY piece ORDER BY pos)
"""
#: Pieces without a pair to contract leave the rounds.
FINISH = ("INSERT INTO finished SELECT piece, pos, token FROM numbered WHERE piece NOT IN (SELECT piece FROM chosen)",
          "DELETE FROM numbered WHERE piece NOT IN (SELECT piece FROM chosen)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Encoder:
    """The merge table in DuckDB and a bounded cache of encoded units."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.space_after_space = re.compile(r"\s ")
        self.cut_at = re.compile(r"(?<=\S) ")
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: What stands after a cut, without its space -> ids joined by commas.
        self.ids: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Of units whose ids do not decode to the unit itself (the pattern leaves something out): what they decode to.
        self.other: dict[str, bytes] = {}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left = ranks.get(token[:i])
                if left is not None and (right := ranks.get(token[i:])) is not None:
                    pairs.append(left * 1048576 + right)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self.load("merges", pair=np.array(pairs, dtype=np.int64), merged=np.array(merged, dtype=np.int64))
        self.load("vocabulary", id=np.fromiter(ranks.values(), np.int32, len(ranks)), hex=[t.hex() for t in ranks])

    def load(self, name: str, **columns) -> None:
        data = pa.table(columns)
        self.db.register("incoming", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_pieces(self, pieces: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Ids joined by commas, and bytes that the ids decode to, of each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pos = np.arange(len(tokens), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = pos == np.repeat(sizes, sizes) - 1
        follower = np.where(last, -1, np.append(tokens[1:], -1))
        piece = np.repeat(np.arange(len(pieces), dtype=np.int64), sizes)
        # A piece that is a token of its own is that token, whether or not merges reach it.
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.repeat(whole, sizes)
        keep = (known < 0) | (pos == 0)
        tokens, follower = np.where(known < 0, tokens, known), np.where(known < 0, follower, -1)
        self.load("symbols", **{k: pa.array(v[keep].astype(np.int32)) for k, v in
                                (("piece", piece), ("pos", pos), ("token", tokens), ("follower", follower))})
        out = self.db.sql(ENCODE if sizes.max() <= LONG_PIECE else self.rounds()).to_arrow_table()
        raw = out.column("raw").to_pylist()
        # One thread aggregates the rows in the order in which the subquery gives them; every piece has to come back.
        if raw != pieces:
            raise ValueError("decoded bytes differ from the text")
        return out.column("ids").to_pylist(), raw

    def rounds(self) -> str:
        """Contract the symbols to the fixpoint, a table of the piece's length at a time; the query for what comes out."""
        self.db.execute("CREATE OR REPLACE TABLE finished (piece INT, pos INT, token INT)").fetchall()
        while True:
            for step in (NUMBER, ROUND, *FINISH):
                self.db.execute(step).fetchall()
            if not self.db.execute("SELECT count(*) FROM chosen").fetchall()[0][0]:
                return WRITTEN.format(rows="finished")
            self.db.execute(CONTRACT).fetchall()

    def blocks(self, pieces: list[bytes]) -> Iterator[list[bytes]]:
        """Pieces, shortest first, by the rows that a query keeps of them."""
        block, rows = [], 0
        for p in pieces:
            n = len(p)
            more = n * (n + 1) // 2 if n <= LONG_PIECE else n
            other = block and (len(block) == PIECES_PER_QUERY or rows + more > ROWS_PER_QUERY or (len(block[0]) <= LONG_PIECE) != (n <= LONG_PIECE))
            if other:
                yield block
                block, rows = [], 0
            block.append(p)
            rows += more
        if block:
            yield block

    def encode_found(self, found: list[list[str]]) -> tuple[list[str], list[bytes]]:
        """Ids and bytes of the pieces of each list, encoded and put together."""
        # Pieces of like length share a query: it takes as many rounds as its longest piece needs.
        pieces = sorted(map(str.encode, set(chain.from_iterable(found))), key=len)
        ids: dict[str, str] = {}
        raws: dict[str, bytes] = {}
        for block in self.blocks(pieces):
            texts = list(map(bytes.decode, block))
            got, raw = self.encode_pieces(block)
            ids.update(zip(texts, got))
            raws.update(zip(texts, raw))
        return ([ids[f[0]] if len(f) == 1 else ",".join(map(ids.__getitem__, f)) for f in found],
                [raws[f[0]] if len(f) == 1 else b"".join(map(raws.__getitem__, f)) for f in found])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """Of each text, null as '': ids joined by commas and the decoded bytes."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < BLOCK_CHARS:
                chars += len(texts[end] or "")
                end += 1
            yield from self.encode_block([t or "" for t in texts[start:end]])
            start = end

    def encode_block(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        cut = [self.cut_at.split(t) if self.space_after_space.search(t) else t.split(" ") for t in texts]
        starts = [c[0] for c in cut]  # no space stands before these
        for c in cut:
            del c[0]
        units = set().union(*cut)
        if len(self.ids) > CACHED_UNITS // 2:
            self.ids, self.older = {}, self.ids
            self.other = {u: raw for u, raw in self.other.items() if u in self.older}
        new = units - self.ids.keys()
        for u in new & self.older.keys():
            self.ids[u] = self.older[u]
        new = list(new - self.older.keys())
        # Letters alone are one match together with the space before them.
        found = [[" " + u] if u.isascii() and u.isalpha() else self.pattern.findall(" " + u) for u in new]
        ids, raws = self.encode_found(found)
        self.ids.update(zip(new, ids))
        self.other.update((u, raw) for u, raw in zip(new, raws) if raw != (" " + u).encode())
        heads = list(set(starts))
        ids, raws = self.encode_found([self.pattern.findall(h) for h in heads])
        head, head_raw = dict(zip(heads, ids)), dict(zip(heads, raws))
        for text, start, c in zip(texts, starts, cut):
            first, ids = head[start], ",".join(map(self.ids.__getitem__, c))
            if head_raw[start] == start.encode() and self.other.keys().isdisjoint(c):
                raw = text.encode()  # every unit has decoded to itself
            else:
                raw = head_raw[start] + b"".join([self.other.get(u, (" " + u).encode()) for u in c])
            yield first + "," + ids if first and ids else first or ids, raw


def encode_texts(docs: DataFrame, text: str = "text", ranks: str = RANKS,
                 pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """Add what byte-level BPE makes of each text.

    Columns added: ``n_tokens`` (long), ``ids_sha256`` and ``decoded_sha256``
    (lower-case hex of the ids joined by commas and of the bytes they decode
    to), and with ``keep_ids`` also ``ids`` (array<int>) and ``decoded``
    (binary). The frame's other columns stay; a column that has one of these
    names is replaced.

    Null and empty texts have no tokens, both digests are of the empty string.
    Repeated rows stay as they are; an empty frame gives an empty frame. A
    single piece of n bytes takes room in proportion to n and n rounds at most, so
    the time for a run of one class of characters without any break grows up to its length squared.

    ``ranks`` is a file of the tokenizers package that every worker has
    installed.
    """
    new = [*DIGESTS, *IDS] if keep_ids else [*DIGESTS]
    arrow_type = pa.struct([(c, {**DIGESTS, **IDS}[c][1]) for c in new])

    @F.arrow_udf("struct<" + ", ".join(f"{c}: {({**DIGESTS, **IDS})[c][0]}" for c in new) + ">")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_local(("bpe", ranks, pattern),
                               lambda: Encoder(read_ranks(public_tokenizers.path(ranks)), pattern))
        for batch in batches:
            rows = []
            for ids, raw in encoder.encode(batch.to_pylist()):
                row = {"n_tokens": ids.count(",") + bool(ids), "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
                       "decoded_sha256": hashlib.sha256(raw).hexdigest()}
                if keep_ids:
                    row |= {"ids": list(map(int, ids.split(","))) if ids else [], "decoded": raw}
                rows.append(row)
            yield pa.array(rows, type=arrow_type)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    (made,) = spare_names(docs, "encoded")
    return docs.select(*kept, encoded(F.col(text)).alias(made)).select(
        *kept, *[F.col(f"{made}.{c}").alias(c) for c in new])


def op7_bpe(docs: DataFrame) -> DataFrame:
    """Token count and digests of every document, as its contract names them."""
    return encode_texts(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
