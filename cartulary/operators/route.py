"""Candidates: files that a query may be answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import terms


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(terms(F.lit(query))).first()[0]


def candidates(spark: SparkSession, term_sets: DataFrame, query: str, most: int | None = fixed.CANDIDATES, key: str = "path") -> DataFrame:
    """(key, score): the sum of 1/df over the query's terms, and 2 for a path with
    the whole query in it.

    ``term_sets`` has a key and ``terms``.  Only the query's terms are exploded,
    so a file is as many rows as it shares terms with the query.
    """
    wanted = query_terms(spark, query)
    if not wanted:
        return spark.createDataFrame([], f"{key} {dict(term_sets.dtypes)[key]}, score double")
    mine = F.array_intersect("terms", F.array(*[F.lit(t) for t in wanted]))
    named = F.lower(F.col(key).cast("string")).contains(query.lower())
    # dealt by key once: over a stored table of terms, counting and scoring read the same exchange
    hits = term_sets.select(key, F.explode_outer(mine).alias("term")).where(F.col("term").isNotNull() | named).repartition(key)
    df = hits.groupBy("term").agg(F.count("term").alias("df"))
    summed = hits.join(F.broadcast(df), "term", "left").groupBy(key).agg(F.coalesce(F.sum(1 / F.col("df")), F.lit(0.0)).alias("score"))
    out = summed.select(key, F.round(F.col("score") + F.when(named, 2.0).otherwise(0.0), 6).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), key).limit(most) if most else out


def merge(router: DataFrame, deterministic: DataFrame) -> DataFrame:
    """One row for each path of either: first rank, best score, first hint.

    ``router`` has (path, router_rank, look_for), ``deterministic`` (path, score);
    a rank of 0 counts as 999, and no deterministic candidate is lost.
    """
    rank = F.when(F.col("router_rank") == 0, 999).otherwise(F.col("router_rank"))
    a = router.select("path", rank.cast("int").alias("router_rank"), F.lit(0.0).alias("score"), "look_for")
    b = deterministic.select("path", F.lit(None).cast("int").alias("router_rank"), "score", F.lit(None).cast("string").alias("look_for"))
    hint = F.when(F.col("look_for") != "", F.col("look_for"))
    return a.unionByName(b).groupBy("path").agg(F.min("router_rank").alias("router_rank"), F.max("score").alias("score"), F.min(hint).alias("look_for"))


def ordered(candidates_: DataFrame) -> DataFrame:
    return candidates_.orderBy(F.asc_nulls_last("router_rank"), F.desc("score"), "path")
