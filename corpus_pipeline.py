"""Corpus preparation in five stages, each one of the ten operators.

Every stage is (name, function of (spark, docs, sf_dir)) and works on all its
predecessor kept; ``run`` writes each stage's result as Parquet in the shared
folder and reads it again.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.byte_bpe import tokenize
from marketlens.llm.decontamination import find_leaks
from marketlens.llm.language_id import UNKNOWN, identify, train_network
from marketlens.llm.ngram_jaccard import one_of_each
from marketlens.llm.pii import redact
from marketlens.llm.registry import load
from marketlens.session import materialize

# A text whose likeliest language stays below this is in none of them.
MIN_LANGUAGE_SCORE = 0.35


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; ``lang`` becomes the language
    found.  Texts without a letter and texts in no known language go."""
    net = train_network(docs)
    language = F.col("_language")
    return (
        identify(docs, net, out="_language")
        .filter((language["lang"] != UNKNOWN) & (language["score"] >= MIN_LANGUAGE_SCORE))
        .withColumn("lang", language["lang"]).drop("_language"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard >= 0.8 on word 5-grams."""
    return one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    found = find_leaks(docs, load(spark, sf_dir, "benchmark"), out="_leaks")
    return found.filter(F.size("_leaks") == 0).drop("_leaks")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its token ids (packed, little-endian unsigned
    32-bit), their number and digest, and whether they decode to the text."""
    coded = tokenize(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        out="_bpe")
    return coded.select(
        "doc_id", "lang", "source", "n_chars",
        F.floor(F.octet_length("_bpe.ids") / 4).alias("n_tokens"),
        F.col("_bpe.ids").alias("token_ids"),
        F.sha2("_bpe.ids", 256).alias("ids_sha256"),
        (F.col("_bpe.decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("byte_bpe", encode_tokens),
]

# Trained networks, LSH and BPE merges are beyond SQL; tests/llm checks each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
