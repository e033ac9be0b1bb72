"""Corpus pipeline: quality rules, near-dedup, secret redaction, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorline.llm import bagminhash, bpe, mixing, rules, secrets
from sensorline.llm.common import stage_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    return rules.keep_good(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return bagminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return secrets.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the target shares of the domains."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, lang, source, ids and their number."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.selectExpr("doc_id", "lang", "source", "ids", "cast(size(ids) as bigint) as n_tokens")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("mixing_weights", mixing_weights),
    ("bpe_encoding", tokens),
]

#: The rules and the mixture are learned and the tokens are not SQL's to give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
