"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import Saved


def large_star(edges: DataFrame, saved: Saved) -> tuple[DataFrame, DataFrame]:
    """Hangs each node's larger neighbours on its least neighbour; and the table of
    least neighbours, written so that the join's sides are plain and a node with
    very many neighbours can be split."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def small_star(edges: DataFrame, saved: Saved) -> tuple[DataFrame, DataFrame]:
    """Hangs each node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = saved.write(down.groupBy("u").agg(F.min("v").alias("m")))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(spark: SparkSession, edges: DataFrame, saved: Saved | None = None, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long) that isn't a root.

    root is the least node that can be reached.  Minima are partial aggregates,
    and the joins' one unique side is a written table, so that Spark can broadcast
    it if it is small, or split a node with very many neighbours over tasks.  Each round is
    written to the shared folder.  Null ends, loops and repeated edges don't count; no edges give an
    empty table.
    """
    saved = saved or Saved(spark)
    now = saved.write(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    seen = None
    for _ in range(most):
        was = now
        hung, least = large_star(was, saved)
        hung = saved.write(hung)
        now, low = small_star(hung, saved)
        now = saved.write(now)
        for old in (was, least, hung, low):
            saved.drop(old)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
    raise RuntimeError(f"components did not settle in {most} rounds")
