"""An inverted index of terms, kept in buckets, so that a question reads its own terms alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import terms

#: Folders that the terms are dealt to by their hash.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(term_sets: DataFrame, key: str = "path") -> DataFrame:
    """(key, term, bucket) for each term of each file, to be written by bucket.

    Rows are dealt by ranges of bucket and term, which splits a term of very many files too,
    and sorted, so that a file of a bucket holds few terms and its statistics tell which.
    ``term_sets`` should be a written table, since ranges are drawn from a first look at it.
    """
    each = term_sets.select(key, F.explode_outer("terms").alias("term")).where("term is not null")
    each = each.withColumn("bucket", bucket(F.col("term")))
    return each.repartitionByRange("bucket", "term", key).sortWithinPartitions("bucket", "term", key)


def counts(posted: DataFrame) -> DataFrame:
    """(term, df, bucket): in how many files each term stands."""
    return posted.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", "bucket")


def wanted(spark: SparkSession, query: str) -> list[tuple[str, int]]:
    """The query's terms and their buckets."""
    found = spark.range(1).select(F.explode(terms(F.lit(query))).alias("term"))
    return [tuple(r) for r in found.select("term", bucket(F.col("term"))).collect()]


def of_terms(table: DataFrame, needed: list[tuple[str, int]]) -> DataFrame:
    """The rows of a bucketed table that ``needed`` names, by partition and statistics."""
    return table.where(F.col("bucket").isin(sorted({b for _, b in needed})) & F.col("term").isin([t for t, _ in needed]))


def candidates(spark: SparkSession, posted: DataFrame, paths: DataFrame, query: str, known: DataFrame | None = None, most: int | None = fixed.CANDIDATES, key: str = "path") -> DataFrame:
    """What ``route.candidates`` gives, from postings: (key, score).

    ``paths`` (key) are all files, looked through for the whole query in their name;
    ``known`` are the terms' counts where they are kept, else the postings are counted.
    """
    needed = wanted(spark, query)
    hits = of_terms(posted, needed).select(key, "term")
    df = of_terms(known, needed).select("term", "df") if known is not None else hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df), "term").select(key, (1 / F.col("df")).alias("s"), F.lit(0.0).alias("bonus"))  # df: the query's terms
    named = paths.where(F.lower(F.col(key).cast("string")).contains(query.lower()) if needed else F.lit(False)).select(key, F.lit(0.0).alias("s"), F.lit(2.0).alias("bonus"))
    summed = scored.unionByName(named).groupBy(key).agg(F.sum("s").alias("s"), F.max("bonus").alias("bonus"))
    out = summed.select(key, F.round(F.col("s") + F.col("bonus"), 6).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), key).limit(most) if most else out
