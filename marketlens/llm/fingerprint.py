"""Document fingerprints by one-permutation MinHash, in column expressions.

A text's shingles are runs of five words (lower-cased, split at white space;
a shorter text is one shingle).  Each shingle is hashed once; the top eight
bits of the hash choose one of ``BINS`` bins, and a bin keeps its least hash.
An empty bin is filled by optimal densification: it takes the value of the
first filled bin in a probe sequence that depends on the bin alone, so two
texts fill it alike.  The fingerprint is the low ``BITS`` bits of each bin,
packed as one hex digit a bin.

Likeness of two fingerprints is the share of equal digits, corrected for the
digits that agree by chance: (share - 2**-BITS) / (1 - 2**-BITS), within 0..1.

Defined results: null text counts as empty; a text without words has an empty
fingerprint, which is wholly like another empty one and not at all like any
other; equal texts have equal fingerprints.  Every input row gives one output
row; rows with equal ids are ordered by text, null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import load, register

BINS = 256  # as many as eight bits tell apart
BITS = 4
PROBES = 12
SPACE = r"[\x20\x09-\x0D]+"
_LOW = (1 << 56) - 1


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as string column ``out``.

    Each step is a column of its own, used more than once by the next, so the
    optimizer does not copy it into the next step's lambda.
    """
    words, hashes, bins = f"_{out}_words", f"_{out}_hashes", f"_{out}_bins"
    df = df.withColumn(words, F.transform(
        F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), ""),
        lambda w: F.xxhash64(w)))
    n = F.size(words)
    w = F.col(words)
    runs = F.transform(
        F.slice(w, 1, F.greatest(n - 4, F.lit(0))),
        lambda h, i: F.xxhash64(h, w[i + 1], w[i + 2], w[i + 3], w[i + 4]))
    whole = F.when(n > 0, F.array(F.aggregate(
        w, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))).otherwise(F.array().cast("array<bigint>"))
    # One mark per bin, larger than any hash there: where it comes first, the
    # bin is empty, and every bin has a first value.
    marks = F.array(*[F.lit(_mark(b)).cast("long") for b in range(BINS)])
    df = df.withColumn(hashes, F.sort_array(F.concat(F.when(n >= 5, runs).otherwise(whole), marks)))
    s = F.col(hashes)
    df = df.withColumn(bins, F.filter(s, lambda h, i: (i == 0) | (
        F.shiftright(h, 56) != F.shiftright(F.get(s, i - 1), 56))))
    b = F.col(bins)

    def empty(v: Column) -> Column:
        return v.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def probe(i: Column, k: int) -> Column:
        at = F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")
        return F.when(~empty(b[at]), b[at])

    def nearest(i: Column) -> Column:
        # The rest of the probe sequence: filled bins by the hash of both.
        return F.array_min(F.transform(
            F.filter(b, lambda v: ~empty(v)),
            lambda v: F.struct(F.xxhash64(i, F.shiftright(v, 56)).alias("k"), v.alias("v"))))["v"]

    filled = F.transform(b, lambda v, i: F.when(~empty(v), v).otherwise(
        # hashed with the bin, else a value that fills many bins would agree by
        # chance in all of them at once
        F.xxhash64(F.coalesce(*[probe(i, k) for k in range(PROBES)], nearest(i)), i)))
    packed = F.array_join(F.transform(
        filled, lambda v: F.hex(v.bitwiseAND(F.lit(2**BITS - 1)))), "")
    return df.withColumn(
        out, F.when(F.size(words) > 0, F.lower(packed)).otherwise(F.lit(""))
    ).drop(words, hashes, bins)


def _mark(b: int) -> int:
    signed = b - BINS // 2
    return (signed << 56) | _LOW


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprint columns."""
    same = F.size(F.filter(
        F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 2.0**-BITS
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when((a == "") & (b == ""), F.lit(1.0))
            .when((a == "") | (b == ""), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))))


def with_next(rows: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` of the following row in order of id and
    text, for each of ``columns``; the last row's next is the first row.

    Ids are cut into ranges at their approximate quantiles, so one shuffle
    brings a range together; the first row of each range also goes to the
    range before it.  The quantiles and first ids, one per range and a fixed
    number of ranges, are all the driver sees.
    """
    spark = rows.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    cuts = [k / ranges for k in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(key, cuts, 10 * ranges).alias("q")).first().q
    bounds = sorted(set(bounds or []))
    at = F.size(F.filter(
        F.array(*[F.lit(q).cast("long") for q in bounds]).cast("array<bigint>"), lambda q: q < key))
    placed = rows.withColumn("_key", key).withColumn("_range", at)
    firsts = placed.groupBy("_range").agg(F.min("_key").alias("k")).orderBy("_range").collect()
    if not firsts:
        return rows.withColumns({f"next_{c}": F.col(c) for c in columns})
    before = {f.k: firsts[i - 1]._range for i, f in enumerate(firsts)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    order = ["_key", F.col(text_col).asc_nulls_first()]
    heads = (
        placed.filter(F.col("_key").isin(list(before)))
        .withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(text_col)))
        .filter("_n = 1").drop("_n")
        .withColumn("_range", to[F.col("_key")])
        .withColumn("_head", F.lit(True))
    )
    w = Window.partitionBy("_range").orderBy("_head", *order)
    both = placed.withColumn("_head", F.lit(False)).unionByName(heads)
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
        .filter(~F.col("_head")).drop("_head", "_range", "_key")
    )


@register("op10_fingerprint")
def op10_fingerprint(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_fingerprint(docs, F.col("text"), "fingerprint")
    docs = with_next(docs, "doc_id", "text", ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "next_fingerprint", "edited")
    return with_fingerprint(docs, F.col("edited"), "edited_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
