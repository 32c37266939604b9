"""Catalogue search over stored trigrams (B2, H5) instead of a scan of every text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRODUCT_TEXT_MAX, ascii_lower, sanitize
from .catalog import search_filter

GRAM = 3
SEARCHED = ["name", "description"]
POSTING_BUCKETS = 256


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    """Different runs of three characters; none in a shorter text."""
    last = F.char_length(text) - (GRAM - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM)))))


def gram_postings(products: DataFrame, buckets: int = POSTING_BUCKETS) -> DataFrame:
    """One row per (trigram, product, searched column), the column as a number."""
    lists = F.array(*[
        F.struct(F.lit(i).alias("field"), _grams(ascii_lower(F.col(c))).alias("grams"))
        for i, c in enumerate(SEARCHED)])
    rows = products.select("id", F.explode(lists).alias("l"))
    return (
        rows.select("id", "l.field", F.explode("l.grams").alias("gram"))
        .withColumn("bucket", _bucket(F.col("gram"), buckets))
    )


def write_postings(products: DataFrame, path: str, buckets: int = POSTING_BUCKETS) -> None:
    """Store the postings in folders by a hash of the trigram, so that a search
    reads the folders of its own trigrams only.  A frequent trigram's folder is
    written by several tasks, as rows are dealt by trigram and product."""
    postings = gram_postings(products, buckets)
    (postings.repartition("bucket", F.pmod(F.hash("id"), F.lit(16)))
     .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path))


def read_postings(spark, path: str) -> DataFrame:
    return spark.read.schema("id bigint, field int, gram string, bucket int").parquet(path)


def pattern_grams(needle: str) -> list[str]:
    """Trigrams that every match of ``%needle%`` holds: those of its parts
    between wildcards.  None for parts under three characters."""
    parts = re.split("[%_]", needle)
    return sorted({p[i:i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def search_products(products: DataFrame, postings: DataFrame, search: str,
                    buckets: int = POSTING_BUCKETS) -> DataFrame:
    """Products whose name or description matches, as :func:`search_filter` has it.

    Postings of the pattern's trigrams are counted per product and column;
    where all occur, the exact pattern is tested.  A pattern without a whole
    trigram is tested on every product.
    """
    spark = products.sparkSession
    needle = spark.range(1).select(ascii_lower(sanitize(F.lit(search), PRODUCT_TEXT_MAX))).first()[0]
    grams = pattern_grams(needle)
    if not grams:
        return products.where(search_filter(search))
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    folders = [r.b for r in wanted.select(_bucket(F.col("gram"), buckets).alias("b")).distinct().collect()]
    hits = (
        postings.where(F.col("bucket").isin(folders) & F.col("gram").isin(grams))
        .groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(grams)).select("id").distinct()
    )
    return products.join(hits, "id", "left_semi").where(search_filter(search))
