"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import Saved, pick, small

#: Documents that one flight moves, on average.
FLIGHT_ROWS = 4_000
#: Probabilities within this of 0 or 1 count as settled.
EPS = 1e-9
#: ASCII white space between words.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(spark: SparkSession, sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    The targets are weight-proportional parts of ``share`` times all sizes; one
    over ``most`` times its source's size stops there, and the excess is shared
    anew by weight among the others until none is above.  Each round is one
    aggregate of a table with a row for each source.
    """
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("weight") * level >= F.col("source_size") * most
        held, open_weight = sources.agg(F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (held or 0)) / open_weight if open_weight else level
        if new <= level:
            return sources.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * most).cast("double"))
        level = new


def flight(pi: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method for two balancing sums, documents and words.

    Three open units at a time are moved along the null space of their
    constraints (1, size), the cross product of the two rows, with steps chosen
    at random so that each unit keeps its expected probability.  Every step
    settles a unit, and both sums stay as they are.  At most two units are left
    between 0 and 1.
    """
    p, x = pi.tolist(), sizes.astype(float).tolist()
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS][::-1]
    draws, used, hand = rng.random(len(waiting) + 1).tolist(), 0, []
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        if len(hand) < 3:
            return np.clip(np.array(p), 0.0, 1.0)
        a, b, c = hand
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(hand, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(hand, u) if d)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for i, d in zip(hand, u):
            p[i] += step * d
        hand = [i for i in hand if EPS < p[i] < 1 - EPS]


def landing(pi: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles the one or two units that flights have left, dropping the
    constraint on documents first and then that on words."""
    p = flight(pi, sizes, rng)
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(left) == 2:
        a, b = left
        u = (sizes[b], -sizes[a]) if sizes[a] and sizes[b] else (1.0, -1.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(left, u))
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(left, u))
        step = up if rng.random() * (up + down) < down else -down
        p[left] += step * np.array(u)
    left = (p > EPS) & (p < 1 - EPS)
    p[left] = rng.random(int(left.sum())) < p[left]
    return np.round(np.clip(p, 0.0, 1.0))


def moved(move: Callable, seed: int):
    """applyInPandas function: one group's probabilities after ``move``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "size"], ignore_index=True)
        rng = np.random.default_rng([seed, *(int(k) & 0xFFFFFFFF for k in key)])
        return rows.assign(pi=move(rows["pi"].to_numpy(), rows["size"].to_numpy(), rng))[["src", "unit", "size", "tie", "pi"]]

    return run


def cube(spark: SparkSession, units: DataFrame, saved: Saved, seed: int = 42, rows: int = FLIGHT_ROWS) -> DataFrame:
    """(unit, picked) for units (src int, unit long, size long, tie long, pi double).

    Units are dealt by source and a hash of their values, a large source over
    many flights; what flights leave, two units each, meets in fewer flights
    until a source has one group, where the landing settles the last.
    """
    schema, done = "src int, unit long, size long, tie long, pi double", []
    settled = (F.col("pi") <= EPS) | (F.col("pi") >= 1 - EPS)
    todo, level = units, 0
    while True:
        n = todo.groupBy("src").agg(F.count(F.lit(1)).alias("rows"))
        n = n.select("src", F.ceil(F.col("rows") / rows).cast("int").alias("parts"))
        n = saved.write(n)
        last = (n.agg(F.max("parts")).first()[0] or 1) <= 1
        part = F.pmod(F.xxhash64("tie", F.lit(seed + level)), F.col("parts")).cast("int")
        dealt = todo.join(n, "src").withColumn("part", part).drop("parts")
        step = saved.write(dealt.groupBy("src", "part").applyInPandas(moved(landing if last else flight, seed + level), schema))
        done.append(step.where(settled))
        if last:
            break
        todo, level = step.where(~settled), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("unit", (F.col("pi") > 0.5).cast("long").alias("picked"))


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, row_col: str | None = None) -> DataFrame:
    """The mix as one row for each row of ``docs``: the id, ``copies`` and more.

    Sources by code point, null last, weigh ``weights``, repeating.  A source's
    target of words over its size is its rate; a document is taken the whole part
    of the rate times, and once more if the cube method picks it for the
    fraction.  Both the words and the documents of a source are balanced.
    Columns: the id, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` (0 to ``most``) and ``taken`` (copies times size).  A null text
    has no words; a source without words has rate 0; repeated rows are units of
    their own; an empty table gives none.  Draws depend on ``seed`` and values
    alone, so reruns agree on any cluster.  ``row_col`` names a column of unique
    longs, if there is one, and is returned as ``unit``.
    """
    saved = Saved(spark)
    tie = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    unit = F.col(row_col) if row_col else F.monotonically_increasing_id()
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), tie.alias("tie"), unit.alias("unit"))
    own = saved.write(own)
    sums = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    sums = saved.write(sums.withColumn("src", rank).withColumn("weight", weight))
    targets = saved.write(water_fill(spark, sums, share, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    planned = own.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    planned = planned.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + EPS))
    planned = saved.write(planned.withColumn("pi", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))))
    picked = cube(spark, planned.where(F.col("pi") > EPS).select("src", "unit", "size", "tie", "pi"), saved, seed)
    out = planned.join(picked, "unit", "left").withColumn("copies", F.col("base") + F.coalesce("picked", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["unit"] if row_col else []))


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each copy taken, 0 to ``most``."""
    row, n = pick(docs.columns, "_row"), pick(docs.columns, "_copies")
    saved = Saved(spark)
    rows = saved.write(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = saved.write(mix(spark, rows, row_col=row, **options).where("copies > 0").select(F.col("unit").alias(row), F.col("copies").alias(n)))
    taken = rows.join(small(plan), row)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
