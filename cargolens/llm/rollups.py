"""Token counts as delta-maintained rollups.

A store holds additive totals (documents, tokens) by source, language and tokenizer
version. Changes come in batches: inserts, deletes and revised counts of
documents. A batch is turned into signed deltas against what the store knows of the same
documents (a semi join with the earlier changes; no text is read again), and the deltas
are added up before they are written, so totals are sums of small rows.

The store is a folder with two tables, both partitioned by batch:

``changes``  what each batch says last of each (document, tokenizer version)
``deltas``   the batch's signed sums by source, language and tokenizer version

A batch's partition is replaced as a whole and appears when its write is committed; an empty batch is a
partition with a mark in it, so it too replaces what stood there. What a batch
changes is worked out only from batches before it; so committing a batch again,
after a failure at any point or by mistake, writes the same rows once more and
changes no total. A batch that comes late, or again with other content, has the deltas of the batches after
it worked out anew. ``settle`` folds finished batches into one row per document, so that later commits
read that state instead of the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_folder, word_count

GROUP = ("source", "lang", "tokenizer")
CHANGES = "doc_id string, tokenizer string, op string, source string, lang string, n_tokens long, seq long, batch long"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long, batch long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"
#: The row that every partition of changes has, however empty the batch.
MARK = "mark"


class Rollups:
    """Additive token totals under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        """Names in a folder of the store; none if it isn't there."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str, schema: str) -> DataFrame:
        """The committed rows of a table; none before the first batch."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._names(name) else (
            self.spark.createDataFrame([], schema))

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(
            f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the batches committed, in order."""
        return sorted(int(n.partition("=")[2]) for n in self._names("changes") if n.startswith("batch="))

    def settled(self) -> int | None:
        """The last batch that ``settle`` has folded in."""
        done = [n for n in self._names("settled") if "_SUCCESS" in self._names(f"settled/{n}")]
        return max((int(n) for n in done), default=None)

    def _before(self, batch: int | None) -> DataFrame:
        """Rows of documents in batches before ``batch`` (None: all): the settled state and what has changed since."""
        since, at = self._read("changes", CHANGES).where(f"doc_id is not null and op <> '{MARK}'"), self.settled()
        if at is not None:
            since = since.where(F.col("batch") > at).unionByName(self.spark.read.schema(CHANGES).parquet(f"{self.path}/settled/{at:012d}"))
        return since if batch is None else since.where(F.col("batch") < batch)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply one batch. ``changes``: doc_id, tokenizer, op, source, lang, n_tokens, seq; others are not read.

        Batches are numbered, from 0, in the order in which they hold, in whatever order they come; a batch sees those with smaller
        numbers, and those with larger ones are worked out anew after it. A settled number is an error. Of several changes to a document in one batch that with the
        largest seq holds (then the largest by op, source, lang, count). An insert or a
        revised count of a document sets source, language and count, whether or not it is known; a
        delete takes away what is known, and nothing if nothing is. A null count is zero tokens; null
        sources, languages and tokenizers are groups of their own. A row without doc_id
        cannot be found again: an insert adds to the totals, a delete takes its own
        count away, a revised count does nothing. After a failure, commit the batch again.
        """
        at = self.settled()
        if at is not None and batch <= at:
            raise ValueError(f"batch {batch} comes too late: batches up to {at} are settled")
        rows = changes.select(F.col("doc_id").cast("string").alias("doc_id"), "tokenizer", "op", "source", "lang",
                              F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
                              F.col("seq").cast("long").alias("seq"))
        last = F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("last")
        named = rows.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(last).select(
            "doc_id", "tokenizer", "last.op", "last.source", "last.lang", "last.n_tokens", "last.seq")
        loose = rows.where(F.col("doc_id").isNull() & F.col("op").isin(INSERT, DELETE))
        mark = self.spark.range(1).select(*[F.lit(MARK if c == "op" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        self._write(named.unionByName(loose).unionByName(mark).withColumn("batch", F.lit(batch).cast("long")), "changes")
        for b in self.batches():
            if b >= batch:
                self._write_deltas(b)

    def _write_deltas(self, batch: int) -> None:
        now = self._read("changes", CHANGES).where((F.col("batch") == batch) & (F.col("op") != MARK))
        key = [F.col("doc_id"), F.col("tokenizer")]
        # Before and after of each document that the batch names, side by side in one aggregate.
        known = self._before(batch).join(now.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t")),
                                         (F.col("doc_id") == F.col("d")) & F.col("tokenizer").eqNullSafe(F.col("t")), "left_semi")
        before = known.groupBy(*key).agg(F.max(F.struct("batch", "op", "source", "lang", "n_tokens")).alias("l")).select(
            "tokenizer", "l.op", "l.source", "l.lang", "l.n_tokens").where(F.col("op") != DELETE)
        named, loose = now.where("doc_id is not null"), now.where("doc_id is null")
        none = self.spark.createDataFrame([(None, None, None, 0, 0)], "source string, lang string, tokenizer string, sign int, n_tokens long")
        signed = before.select(*GROUP, F.lit(-1).alias("sign"), "n_tokens").union(
            named.where(F.col("op") != DELETE).select(*GROUP, F.lit(1), "n_tokens")).union(
            loose.select(*GROUP, F.when(F.col("op") == INSERT, 1).otherwise(-1), "n_tokens")).union(none)
        deltas = signed.groupBy(*GROUP).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        self._write(deltas.withColumn("batch", F.lit(batch).cast("long")), "deltas")

    def settle(self) -> None:
        """Fold all batches so far into one row per (document, tokenizer version). They can't be committed again."""
        upto = max(self.batches(), default=None)
        if upto is not None and upto != self.settled():
            last = self._before(None).groupBy("doc_id", "tokenizer").agg(F.max(F.struct("batch", "op", "source", "lang", "n_tokens", "seq")).alias("l"))
            last.select("doc_id", "tokenizer", "l.op", "l.source", "l.lang", "l.n_tokens", "l.seq", "l.batch").where(
                F.col("op") != DELETE).write.mode("overwrite").parquet(f"{self.path}/settled/{upto:012d}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all batches; groups left without documents are gone."""
        return self._read("deltas", DELTAS).groupBy(*GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where(
            (F.col("documents") != 0) | (F.col("tokens") != 0))


#: Counting rules by version: runs of anything but white space; letters, digits and other signs apart.
WORDS, SIGNS = "words-1", "signs-1"
SIGNS_PATTERN = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9\x{80}-\x{10FFFF}]"
#: A document below so many words is withdrawn by the last batch.
MIN_WORDS = 20


def op2_token_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Totals after a life of four batches over all documents.

    1: every document is inserted under ``words-1``. 2: every document is inserted under ``signs-1``. 3: documents
    without their repeated lines: the revised count under ``words-1`` leaves out lines that repeat one
    above. 4: documents of fewer than MIN_WORDS words are deleted under both versions. Batch 2 is
    committed once more at the end, which changes nothing.
    """
    store = Rollups(spark, fresh_folder(spark, "rollups"))
    n_words = word_count(F.col("text"))
    base = docs.select("doc_id", "source", "lang", "text").withColumn("seq", F.lit(0))
    lines = F.split(F.col("text"), "\n", -1)
    revised = word_count(F.array_join(F.array_distinct(lines), "\n"))
    words = base.select("*", F.lit(WORDS).alias("tokenizer"), n_words.alias("n_tokens"))
    signs = base.select("*", F.lit(SIGNS).alias("tokenizer"),
                        F.coalesce(F.regexp_count("text", F.lit(SIGNS_PATTERN)), F.lit(0)).alias("n_tokens"))
    fewer = words.withColumn("revised", revised).where("revised <> n_tokens").withColumn("n_tokens", F.col("revised"))
    short = words.where(F.col("n_tokens") < MIN_WORDS)
    gone = short.union(short.withColumn("tokenizer", F.lit(SIGNS)))
    for batch, op, rows in ((1, INSERT, words), (2, INSERT, signs), (3, REVISE, fewer), (4, DELETE, gone), (2, INSERT, signs)):
        store.commit(batch, rows.withColumn("op", F.lit(op)))
    return store.totals()


ORACLE = f"""
WITH d AS (
    SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
           len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[0-9]+|[^\\x20\\x09-\\x0DA-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]')) AS signs,
           len(regexp_extract_all(coalesce(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), ''),
               '[^\\x20\\x09-\\x0D]+')) AS revised
    FROM documents),
-- of rows that share an id the largest by source, language and count holds in each batch
said AS (
    SELECT 1 AS batch, '{WORDS}' AS tokenizer, doc_id, source, lang, words AS n FROM d
    UNION ALL SELECT 2, '{SIGNS}', doc_id, source, lang, signs FROM d
    UNION ALL SELECT 3, '{WORDS}', doc_id, source, lang, revised FROM d WHERE revised <> words),
held AS (
    SELECT * FROM said WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM d WHERE words < {MIN_WORDS} AND doc_id IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY tokenizer, doc_id
        ORDER BY batch DESC, source DESC NULLS LAST, lang DESC NULLS LAST, n DESC) = 1),
-- rows without an id are added, and taken away by their own count of words, one by one
signed AS (
    SELECT source, lang, tokenizer, 1 AS documents, n FROM held
    UNION ALL SELECT source, lang, tokenizer, 1, n FROM said WHERE doc_id IS NULL AND batch < 3
    UNION ALL SELECT source, lang, t.tokenizer, -1, -words FROM d, (VALUES ('{WORDS}'), ('{SIGNS}')) t(tokenizer)
              WHERE doc_id IS NULL AND words < {MIN_WORDS})
SELECT source, lang, tokenizer, sum(documents)::BIGINT AS documents, sum(n)::BIGINT AS tokens
FROM signed GROUP BY source, lang, tokenizer
HAVING sum(documents) <> 0 OR sum(n) <> 0
"""
