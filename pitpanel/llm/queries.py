"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitpanel.llm import op1_bpe, op2_decontaminate, op3_token_count, op4_simhash, op5_pii, op6_secrets, op7_media, op8_url_filter, op9_langid, op10_sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op1_bpe.digests(op1_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, and_decode=True))


def op2_decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontaminate.digests(op2_decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_token_count.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_langid.train_and_predict(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = op8_url_filter.host_and_path(pages["url"])
    return op8_url_filter.judge(pages, listed=pages.filter(host.rlike(op8_url_filter.SPAM)).select("url"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_media.store_and_describe(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_pii.digests(op5_pii.find(docs, op5_pii.learn(docs)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.digests(op6_secrets.find(table(spark, sf_dir, "documents")))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding.digests(op10_sharding.assign(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = ("op10_shard_assignment", "op4_simhash_groups", "op6_secret_scan", "op5_pii_spans", "op7_media_columns", "op8_url_rules", "op9_language_id", "op1_byte_bpe", "op2_decontaminate_benchmark", "op3_token_counts")
    return {name: globals()[name] for name in names}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate_benchmark": op2_decontaminate.SQL, "op6_secret_scan": op6_secrets.SQL, "op8_url_rules": op8_url_filter.SQL}
