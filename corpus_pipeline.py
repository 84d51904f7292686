"""Corpus pipeline: toxicity, near duplicates, mixing, byte-level BPE.

Every stage takes what the one before kept, as written Parquet, and returns
documents; the last returns token counts. ``run`` applies them to the documents table.
SQL cannot express the stages (ORACLE_SQL is None): tests/llm/test_pipeline.py
holds run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm import bpe, mixing, simhash, toxicity
from cargolens.llm.common import fresh_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of these documents.

    Null and empty texts score as texts without words, repeated rows alike; without toxic labels, or without rows, all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints.

    Null and empty texts share a fingerprint; a null id comes last, and of repeated rows one stays; no rows give none."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole: a source's last one if that comes nearer to its target.

    Documents without words go, a null source is a source, repeated rows count together; no rows give none."""
    return mixing.repeat_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document of the mix, with its source and language.

    A null text is an empty one, without tokens; every row stays, repeated or not."""
    return bpe.encode_texts(docs).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written under spark.checkpoint.dir and read again."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
