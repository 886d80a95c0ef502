"""Sharding by balanced label propagation over linked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import Saved, gapless

#: Most rounds of propagation.
ROUNDS = 8


def chance(*of: Column) -> Column:
    """A number in [0, 1) that depends on ``of`` alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def loads(table: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: ``shards`` numbers, whatever the input."""
    found = {r[0]: r[1] for r in table.groupBy("shard").agg(F.count(F.lit(1))).collect()}
    return [found.get(s, 0) for s in range(shards)]


def numbers(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def propagate(spark: SparkSession, linked: DataFrame, quota: list[int], saved: Saved, seed: int, rounds: int) -> DataFrame:
    """``linked`` (unit, g1, g2, shard, ...) with its labels moved.

    In each round a document looks at its neighbours' shards, as counts for each
    group and shard, and wishes to go where most of them are among shards with
    room; ties are broken by lot, lest some shards fill up.  A shard's wishes are granted at random
    in the proportion of its room to them, so that its quota holds on average;
    ``settle`` makes it exact.
    """
    shards = len(quota)
    now = saved.write(linked)
    for k in range(rounds):
        room = [max(0, q - n) for q, n in zip(quota, loads(now, shards))]
        counts = now.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
        around = counts.groupBy("g1", "g2").agg(F.collect_list(F.struct("n", F.xxhash64("g1", "shard").alias("lot"), "shard")).alias("around"))
        open_ = F.array_max(F.filter("around", lambda x: F.element_at(numbers(room), x["shard"] + 1) > 0))
        best = around.select("g1", "g2", "around", open_.alias("best"))
        best = saved.write(best)  # so that the join's sides are plain, and a large group's can be split
        seen = now.join(best, ["g1", "g2"])
        here = F.element_at(F.filter("around", lambda x: x["shard"] == F.col("shard")), 1)
        to = F.when(F.coalesce(F.col("best") > here, F.lit(False)), F.col("best.shard")).otherwise(F.col("shard")).cast("int")
        wish = saved.write(seen.withColumn("to", to).drop("around", "best"))
        asked = loads(wish.where("to <> shard").select(F.col("to").alias("shard")), shards)
        if not sum(asked):
            break
        odds = [min(1.0, r / a) if a else 0.0 for r, a in zip(room, asked)]
        granted = chance(F.lit(seed + k), F.col("tie"), F.col("unit")) < F.element_at(numbers(odds), F.col("to") + 1)
        was, now = now, saved.write(wish.withColumn("shard", F.when(granted, F.col("to")).otherwise(F.col("shard"))).drop("to"))
        for old in (was, wish, best):
            saved.drop(old)
    return now


def settle(linked: DataFrame, single: DataFrame, quota: list[int], saved: Saved) -> DataFrame:
    """Gives every row its shard so that each has exactly its quota.

    Linked rows beyond a shard's quota, and all single rows, go to the shards
    that lack rows, by their place in one gapless order.
    """
    shards = len(quota)
    placed = saved.write(gapless(linked, ["shard"], [F.col("g1"), F.col("tie"), F.col("unit")], "place"))
    stays = F.col("place") < F.element_at(numbers(quota), F.col("shard") + 1)
    held = placed.where(stays).drop("place")
    loose = placed.where(~stays).drop("place").unionByName(single)
    lack, edges = [q - n for q, n in zip(quota, loads(held, shards))], [0]
    for n in lack:
        edges.append(edges[-1] + n)
    spread = saved.write(gapless(loose, [], [F.col("tie"), F.col("unit")], "place"))
    shard = F.size(F.filter(numbers(edges[1:]), lambda e: e <= F.col("place"))).cast("int")
    return held.unionByName(spread.withColumn("shard", shard).drop("place"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``shard``, ``slot``) for each row of ``docs``.

    Rows of equal texts are linked.  They start in hashed shards and move towards
    their neighbours' under quotas, round by round, so that few links are cut;
    shards' row counts end at most one apart.  A group larger than a quota is
    split over shards.  ``size`` is the text's UTF-8 bytes (null: none) plus 16,
    ``slot`` numbers a shard's rows from 0.  Null texts are equal to each other
    but not to empty ones; a null id is a value like any other; repeated rows
    are rows of their own; an empty table gives none; other columns aren't read.
    """
    saved = Saved(spark)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    tie = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    group = [F.xxhash64(F.col(text_col)).alias("g1"), F.xxhash64(F.lit(seed), F.col(text_col), F.col(text_col).isNull()).alias("g2")]
    own = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), *group, tie.alias("tie"))
    own = own.withColumn("unit", F.monotonically_increasing_id()).withColumn("shard", F.pmod("tie", F.lit(shards)).cast("int"))
    own = saved.write(own)
    total = own.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    several = saved.write(own.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g1", "g2"))
    single = own.join(several, ["g1", "g2"], "left_anti")
    linked = propagate(spark, own.join(several, ["g1", "g2"], "left_semi"), quota, saved, seed, rounds)
    done = saved.write(settle(linked, single, quota, saved))
    out = gapless(done, ["shard"], [F.col("tie"), F.col("unit")], "slot", total)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
