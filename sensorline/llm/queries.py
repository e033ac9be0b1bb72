"""Registered queries of the corpus operators: thin bindings to the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorline.llm import bagminhash, bpe, conversations, html, infill, itq, langid, mixing, rules, secrets, shards, tokencount, urls
from sensorline.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rules.judge(documents, rules.learn(documents, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_pages(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op6_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_mixing": op2_mixing,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filter": op4_url_filter,
        "op5_language_id": op5_language_id,
        "op6_itq_dedup": op6_itq_dedup,
        "op7_bagminhash_dedup": op7_bagminhash_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_token_counts": op10_token_counts,
        "op8_bpe_codec": op8_bpe_codec,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urls.ORACLE, "op12_fill_in_middle": infill.ORACLE, "op13_sharding": shards.ORACLE}
