"""The registered queries of this subpackage and their DuckDB SQL.

op1, op4, op6, op7, op8, op10 and op11 have no SQL; ``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, hard_negatives, licenses, lm, mixing, rollups, simhash, spelling, topk, toxicity, url_filters
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules and by the words of host and path."""
    return url_filters.op1_url_filters(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after batches of changes."""
    return rollups.op2_token_counts(spark, table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.op3_mixing(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.op4_simhash(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 20 highest integer inner products of every query vector."""
    return topk.op5_topk(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, counts and round trip of byte-level BPE over all documents."""
    return bpe.op7_bpe(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest found of every query vector."""
    return ann.op8_ann(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every document, as a whole and by line."""
    return licenses.op9_licenses(spark, table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.op10_lm(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with the far more frequent words one edit away."""
    return spelling.op11_spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor vector and each of its positives."""
    return hard_negatives.op12_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted for training, with its loss mask, as read back."""
    return chat.op13_chat_format(spark, table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_url_filters, op2_token_counts, op3_mixing, op4_simhash, op5_topk, op6_toxicity, op7_bpe, op8_ann, op9_licenses,
    op10_lm, op11_spelling_variants, op12_hard_negatives, op13_chat_format)}

ORACLES: dict[str, str] = {
    "op2_token_counts": rollups.ORACLE, "op3_mixing": mixing.ORACLE, "op5_topk": topk.ORACLE,
    "op9_licenses": licenses.oracle(), "op12_hard_negatives": hard_negatives.ORACLE, "op13_chat_format": chat.ORACLE}
