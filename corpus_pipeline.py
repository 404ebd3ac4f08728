"""A corpus pipeline: quality, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet and reads it back as the next stage's docs. Tables that a stage needed on its way go then.

Defined results, of all stages: a null text counts as empty; null and repeated doc_ids and repeated rows
are rows of their own, but for near_dedup, which keeps one row of each group and, of rows without
words, all; an empty table stays empty; columns that documents have besides doc_id, text and source are
passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import bpe, mixing, neardup, quality, secrets
from usagelens.llm.common import materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the text, documents that fail go altogether (those with a null or empty text, too)."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8; that with the least doc_id, null counting last."""
    return neardup.dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; a null text stays null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files, and rows in them. A null source is a source of its own."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the checksums of the round trip, and its position in the mix, by its place in the files of that stage."""
    return bpe.encode(mixing.in_order(docs), carry=("position",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: Subword encoding is beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name, replaces=docs)
            kept.append(docs)
    return docs
