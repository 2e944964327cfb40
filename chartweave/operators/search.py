"""WIN-08 over an index: substring search by bitmaps of trigrams.

Every three characters in a row of a page have a posting: a bitmap of the pages that hold
them. The pages that may hold a word are those in all of its trigrams' bitmaps; only they
are read and searched as ``search_patients`` searches all. A longer table makes bitmaps
longer, not the pages that a query reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.operators.windows import search_hay, search_patients, search_tokens

GRAM = 3
#: Every trigram, one from each character on: the text is read once, where cutting them by their places would count to each place.
GRAMS = r"(?s)(?=(.{3}))."
#: Characters of a page whose trigrams are cut at once.
CHUNK = 1000
#: Bits of a bitmap; fixed by the bitmap functions.
BITS = 32768


def write_index(index: DataFrame, folder: str) -> None:
    """Write ``index`` (``id, display_name, search`` and more) as numbered pages, and the postings of its trigrams.

    Pages get their numbers once, as they are written; each bitmap belongs to a bucket of
    ``BITS`` numbers, and pages lie in a folder for each bucket.
    """
    spark = index.sparkSession
    numbered = index.withColumn("slot", F.monotonically_increasing_id() + 1).withColumn("bucket", F.bitmap_bucket_number("slot"))
    numbered.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages").select("slot", "bucket", F.concat(search_hay(), F.lit("  ")).alias("hay"))
    # Chunks are rows of their own, so that no long text becomes one long list of trigrams.
    starts = F.sequence(F.lit(0), F.floor((F.length("hay") - GRAM) / CHUNK).cast("int"))
    chunks = pages.select("slot", "bucket", F.explode(F.transform(starts, lambda k: F.substring("hay", k * CHUNK + 1, CHUNK + GRAM - 1))).alias("c"))
    grams = chunks.select("slot", "bucket", F.explode(F.array_distinct(F.regexp_extract_all("c", F.lit(GRAMS), F.lit(1)))).alias("gram"))
    postings = grams.groupBy("gram", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("pages"))
    # Sorted by trigram: a lookup skips the row groups of all others.
    postings.repartitionByRange("gram").sortWithinPartitions("gram", "bucket").write.mode("overwrite").parquet(f"{folder}/postings")


def candidate_pages(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """``(bucket, slot)`` of the pages that may hold a word of the query.

    A word of three characters or more is looked up by its trigrams; a shorter one takes all
    trigrams that contain it.
    """
    postings, found = spark.read.parquet(f"{folder}/postings"), None
    for token in search_tokens(query):
        grams = sorted({token[i : i + GRAM] for i in range(len(token) - GRAM + 1)})
        if grams:
            of = postings.filter(F.col("gram").isin(grams)).groupBy("bucket").agg(F.bitmap_and_agg("pages").alias("pages"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        else:
            of = postings.filter(F.contains("gram", F.lit(token))).groupBy("bucket").agg(F.bitmap_or_agg("pages").alias("pages"))
        of = of.select("bucket", "pages")
        found = of if found is None else found.unionByName(of)
    if found is None:
        return spark.createDataFrame([], "bucket long, slot long")
    both = found.groupBy("bucket").agg(F.bitmap_or_agg("pages").alias("pages"))
    return both.select("bucket", F.explode(set_bits("pages")).alias("bit")).select("bucket", ((F.col("bucket").cast("bigint") - 1) * BITS + F.col("bit") + 1).alias("slot"))


def set_bits(bitmap: Column | str) -> Column:
    """Places of the bits that are set, as an array."""
    text = F.hex(bitmap)
    byte = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    # Most bytes are 0: those are left out before their bits are looked at.
    full = F.filter(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda i: F.substring(text, 2 * i + 1, F.lit(2)) != "00")
    bits = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.bit_get(byte(i), b) == 1, i * 8 + b)), lambda x: x.isNotNull())
    return F.flatten(F.transform(full, bits))


def search_index(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """Ranked search as ``search_patients`` gives it, from the pages that may match."""
    pages = spark.read.parquet(f"{folder}/pages")
    if search_tokens(query):
        pages = pages.join(candidate_pages(spark, folder, query), ["bucket", "slot"], "left_semi")
    return search_patients(pages, query)
