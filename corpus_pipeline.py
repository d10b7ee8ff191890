"""From raw documents to tokens: the corpus operators one after the other.

Each stage works on all rows that the one before it kept, whatever their columns are named.

Defined results: a document without a language (a null, empty or letterless text) goes in the
first stage; a null id is an id like others, and the last among copies. Repeated rows are copies
of each other, of which one stays; of copies with one id, that which is read first. Ties inside
a stage are settled as its operator says. A text of any length is read whole. An empty table
gives empty tables, and an empty benchmark leaves all documents alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitpanel.llm import op1_bpe, op2_decontaminate, op4_simhash, op5_pii, op9_langid
from pitpanel.llm.common import store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told: null texts and those without letters go; repeats stay."""
    return op9_langid.known_language(docs, op9_langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles), that of the smallest id."""
    return op4_simhash.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, the words of whole benchmark windows go.

    Null items count as none; repeated documents are judged alike.
    """
    return op2_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; every document stays, null texts as they are."""
    return op5_pii.redact(docs, op5_pii.learn(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: encoded texts, and a digest of them decoded again.

    A null text is an empty one and has no tokens; a row for each document.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op1_bpe.encode(docs, path, public_tokenizers.PATTERN, and_decode=True).selectExpr("doc_id", "n_tokens", "ids", "sha2(decoded, 256) AS decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Fingerprint components and the field's spans aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
