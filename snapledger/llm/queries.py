"""The operators' queries, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontamination, lm_scoring, mixing, ngram_join, quality, sharding, urls, warc
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.query_entries(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takings(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents"), join=ngram_join.CONTRACT)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archived(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_source_mixing, op3_ngram_join, op4_sharding, op5_lm_scoring, op6_warc, op7_quality_classifier, op8_chat_formatting, op9_nearest_neighbours, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": urls.ORACLE_SQL,
        "op2_source_mixing": mixing.ORACLE_SQL,
        "op4_sharding": sharding.oracle_sql(),
        "op6_warc": warc.ORACLE_SQL,
        "op8_chat_formatting": chat.ORACLE_SQL,
        "op10_decontamination": decontamination.ORACLE_SQL,
    }
