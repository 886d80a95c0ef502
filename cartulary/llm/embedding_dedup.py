"""Embedding near-duplicates by iterative quantisation and multi-index tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from cartulary.llm.common import Saved
from cartulary.llm.components import components

#: Vectors that rotations are fitted on, and their alternations.
SAMPLE, ALTERNATIONS = 4_096, 40
#: Bits of a code, one rotation's; least and most bits of a table's key.
BITS = 64
KEYS = (16, 32)
#: Odds that the tables miss a pair just at the least cosine, were bits independent.
MISS = 0.055
#: Codes beyond which the mean is no origin, and vectors of the sample whose pairs are
#: looked at to choose one.
MOST, MEASURED = 64, 1_024
#: Deviations by which codes of linked vectors may differ more than on average.
SPREAD = 4


def opening(units: np.ndarray, origin: np.ndarray, least: float) -> np.ndarray:
    """For each of the unit vectors the part of half a turn by which ``origin`` sees it
    apart from one at cosine ``least`` that lies as far along ``origin``."""
    along, square = units @ origin, origin @ origin
    inner, norm = least - 2 * along + square, 1 - 2 * along + square
    return np.arccos(np.clip(inner / np.maximum(norm, 1e-12), -1.0, 1.0)) / np.pi


def tables_for(n: int, apart: np.ndarray, most: float = math.inf) -> tuple[int, int]:
    """(bits of a key, codes) for ``n`` vectors whose linked ones are ``apart``.

    A key has as many bits as the number of vectors has, so that a bucket's size
    stays the same however many there are; longer keys are missed more often and
    take more tables, of which a code has BITS // bits.  No codes if ``most`` are too few.
    """
    bits = min(KEYS[1], max(KEYS[0], math.ceil(math.log2(max(n, 2)))))
    miss = 1 - (1 - apart) ** bits - bits * apart * (1 - apart) ** (bits - 1)
    codes, each = 1, BITS // bits
    while np.mean(miss ** (codes * each)) > MISS:
        codes += 1
        if codes > most:
            return bits, 0
    return bits, codes


def near_bits(apart: np.ndarray) -> int:
    """Most bits of one code in which linked vectors differ."""
    p = float(np.quantile(apart, 0.99))
    return min(BITS, math.floor(p * BITS + SPREAD * math.sqrt(p * (1 - p) * BITS)))


def met(units: np.ndarray, bits: np.ndarray, key: int, codes: int, near: int, least: float) -> float:
    """Which part of the pairs of ``units`` that do not link would be reranked: seen
    with one code, taken to be alike with the others."""
    some = bits[:MEASURED].astype(np.float32)
    strange = np.triu(units[:MEASURED] @ units[:MEASURED].T < least, 1)
    missed, total = np.ones(strange.shape, bool), np.zeros(strange.shape, np.float32)
    for at in range(BITS):
        total += some[:, at, None] != some[None, :, at]
    for at in range(BITS // key):
        part = some[:, at * key : (at + 1) * key]
        missed &= part @ (1 - part).T + (1 - part) @ part.T > 1
    count = max(1, int(strange.sum()))
    once, inside = float((~missed & strange).sum()) / count, float(((total <= near) & strange).sum()) / count
    return min(1 - (1 - once) ** codes, inside)


def fit(sample: np.ndarray, codes: int = 2, alternations: int = ALTERNATIONS, seed: int = 42, origin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(origin, projections): for each code a d x 64 matrix, learnt by ITQ.

    ``origin`` is zero unless given.  The sample is projected on its principal
    directions there; from a random rotation on, codes as signs and the rotation
    nearest to them (by an SVD) take turns, so that bits are balanced and lose
    little.  Fewer than 64 dimensions are first spread over 64 by random directions.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    origin = np.zeros(d) if origin is None else origin
    sample = sample - origin
    basis = np.linalg.svd(sample.T @ sample / len(sample) + 1e-12 * np.eye(d))[0][:, :BITS]
    if basis.shape[1] < BITS:
        basis = basis @ rng.standard_normal((basis.shape[1], BITS))
    v, out = sample @ basis, []
    for _ in range(codes):
        r = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        for _ in range(alternations):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        out.append(basis @ r)
    return origin, np.stack(out)


def index_for(units: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(origin, projections, bits of a key, near) for ``n`` vectors like the sample ``units``.

    Links go by the angle at zero, but a common part of all vectors makes codes seen
    from there alike; seen from the mean, codes are balanced, and the angle of
    linked vectors is wider and takes more tables.  Of the two the one is taken that
    costs a vector less: its rows in the tables, and the strangers of ``n`` that it
    would be reranked with.
    """
    choices = []
    for origin, most in ((np.zeros(units.shape[1]), math.inf), (units.mean(axis=0), MOST)):
        apart = opening(units, origin, least)
        bits, codes = tables_for(n, apart, most)
        if not codes:
            continue
        seen = (units - origin) @ fit(units, 1, origin=origin)[1][0] >= 0
        rows = codes * (BITS // bits) * (1 + bits / 2)
        choices.append((rows + met(units, seen, bits, codes, near_bits(apart), least) * n / 2, origin, codes, bits, near_bits(apart)))
    _, origin, codes, bits, near = min(choices, key=lambda c: c[0])
    return *fit(units, codes, origin=origin), bits, near


def coder(origin: np.ndarray, projections: np.ndarray):
    """Column function from vectors to their codes, an array of longs."""

    @pandas_udf(T.ArrayType(T.LongType()))
    def code(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) - origin
        bits = np.stack([np.packbits(x @ p >= 0, axis=1, bitorder="little").view(np.int64)[:, 0] for p in projections], axis=1)
        return pd.Series(list(bits))

    return code


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def candidates(classes: DataFrame, bits: int, codes: int, near: int) -> DataFrame:
    """(a, b), a < b, of classes whose codes agree in a table up to one bit.

    A code is cut into keys of ``bits`` bits, one Hamming table each.  A vector
    stands in each table under its key; it asks under that and under those that
    have one more bit set, so that of two keys one bit apart one asks for the
    other.  A row carries the id, the key with its table's number, and the first
    code, by which most strangers in a bucket go before anything else is read.
    """
    mask = (1 << bits) - 1
    parts = [F.shiftrightunsigned(F.col("codes")[c], at * bits).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((c * (BITS // bits) + at) << bits)) for c in range(codes) for at in range(BITS // bits)]
    stands = classes.select("cid", F.col("codes")[0].alias("code"), F.explode(F.array(*parts)).alias("key"))
    more = [F.when(F.col("key").bitwiseAND(F.lit(1 << i)) == 0, F.col("key").bitwiseOR(F.lit(1 << i))) for i in range(bits)]
    asks = stands.select(F.col("cid").alias("a"), F.col("code").alias("x"), F.posexplode(F.array(F.col("key"), *more)).alias("flip", "key")).where("key is not null")
    met = asks.join(stands.select(F.col("cid").alias("b"), F.col("code").alias("y"), "key"), "key")
    met = met.where(((F.col("flip") > 0) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= near))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(id, ``n_links``, ``component_id``) for each row of ``vectors``.

    Two vectors link at cosine ``least`` or more.  Origin and rotations are fitted on
    at most ``sample`` vectors, those with the least hashes; every vector is indexed.
    Equal vectors are one class and never paired: their links are counted as
    sizes.  Candidate pairs are reranked by the vectors themselves, so no link is
    false; few are missed (see README).  Vectors that aren't ``usable``, or of
    another length than most are, have no link and are their own component;
    repeated rows are vectors of their own; an empty table gives none.
    """
    saved = Saved(spark)
    h = [F.xxhash64(vector_col).alias("h1"), F.xxhash64(F.lit(42), F.col(vector_col)).alias("h2")]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), usable(F.col(vector_col)).alias("ok"), *h)
    common = rows.where("ok").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == (common["d"] if common else 0)))
    good = rows.where("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.first("v").alias("v"))
    good = saved.write(good.withColumn("cid", F.monotonically_increasing_id()))
    taken = good.select("h1", "h2", "v").orderBy("h1", "h2").limit(sample).select("v").collect()
    if len(taken):
        x = np.array([r[0] for r in taken], np.float64)
        origin, projections, bits, near = index_for(x / np.linalg.norm(x, axis=1, keepdims=True), good.count(), least)
        classes = saved.write(good.select("cid", coder(origin, projections)(F.col("v")).alias("codes")))
        pairs = candidates(classes, bits, len(projections), near)
    else:
        pairs = spark.createDataFrame([], "a long, b long")
    ends = good.select(F.col("cid"), "n", "v")
    a, b = (ends.select(*[F.col(c).alias(f"{side}_{c}") for c in ends.columns]) for side in "ab")
    linked = pairs.join(a, F.col("a") == F.col("a_cid")).join(b, F.col("b") == F.col("b_cid"))
    linked = saved.write(linked.where(cosine(F.col("a_v"), F.col("b_v")) >= least).select("a", "b", "a_n", "b_n"))
    both = linked.select(F.col("a").alias("cid"), F.col("b_n").alias("m")).unionAll(linked.select(F.col("b").alias("cid"), F.col("a_n").alias("m")))
    beside = both.groupBy("cid").agg(F.sum("m").alias("others"))
    roots = components(spark, linked.select(F.col("a").alias("u"), F.col("b").alias("v")), saved)
    rooted = good.join(roots, good["cid"] == roots["node"], "left").join(beside, "cid", "left")
    rooted = rooted.select("h1", "h2", "n", "low", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "cid").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("h1", "h2", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id")
    out = rows.select("id", "ok", "h1", "h2").join(named, ["h1", "h2"], "left")
    n_links = F.when(F.col("ok"), F.col("n_links")).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
