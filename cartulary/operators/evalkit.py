"""Scoring against golden suites: recall, coverage, poison and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import ascii_lower, restricts, stem, strings, terms

CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9_-]*\b"


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, 100.0).otherwise(n / d * 100.0)


def recall(must_find: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, found, total): files of golden facts among the candidates."""
    found = candidates.select("query_id", F.col("path").alias("file")).distinct().withColumn("hit", F.lit(1))
    joined = must_find.select("query_id", "file").distinct().join(found, ["query_id", "file"], "left")
    return joined.groupBy("query_id").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.count(F.lit(1)).alias("total"))


def covered(must_find: DataFrame, findings: DataFrame) -> DataFrame:
    """``must_find`` with ``covered``: a finding in the same file within five lines,
    or sharing over half the golden fact's terms."""
    f = findings.select(F.col("query_id").alias("q"), F.col("file").alias("f"), F.col("line").alias("l"), terms(F.col("fact")).alias("has"))
    want = terms(F.col("fact"))
    share = F.size(F.array_intersect(want, "has")) / F.size(want) > fixed.COVER_OVERLAP
    near = F.abs(F.col("l") - F.col("line")) <= fixed.LINE_TOLERANCE
    fits = (F.col("query_id") == F.col("q")) & (F.col("file") == F.col("f")) & (near | ((F.size(want) > 0) & share))
    yes = must_find.join(f, fits, "left_semi").withColumn("covered", F.lit(True))
    no = must_find.join(f, fits, "left_anti").withColumn("covered", F.lit(False))
    return yes.unionByName(no)


def required(poison: Column) -> Column:
    """Stems of the capitalised words that say what a poisoned fact is about."""
    names = F.filter(F.regexp_extract_all(poison, F.lit(CAPITALISED), F.lit(0)), lambda w: ~w.isin(*fixed.GENERIC))
    return F.array_distinct(F.transform(names, lambda w: stem(ascii_lower(w))))


def asserts(poison: Column, query: Column, fact: Column) -> Column:
    """The fact asserts the poisoned one."""
    want, has, need = terms(poison), terms(fact), required(poison)
    low = ascii_lower(fact)
    counter = F.lit(False)
    for phrase in fixed.COUNTER:
        counter |= low.contains(phrase)
    counter &= ~ascii_lower(poison).contains("not")
    own = F.array_except(F.array_except(F.array_except(want, terms(query)), need), strings(fixed.POISON_WORDS))
    named = F.size(F.array_except(need, has)) == 0
    limits = ~restricts(poison) | restricts(fact)
    marked = (F.size(own) == 0) | (F.size(F.array_intersect(own, has)) >= F.least(F.size(own), F.lit(2)))
    share = F.size(F.array_intersect(want, has)) / F.size(want) > fixed.POISON_OVERLAP
    return (F.size(want) > 0) & ~counter & named & limits & marked & share


def survivors(poison: DataFrame, findings: DataFrame) -> DataFrame:
    """``poison`` (query_id, id, query, poison) with ``survives``: a finding of the
    same query asserts it.  A suite is a few facts, and the join is on its query."""
    f = findings.select(F.col("query_id").alias("q"), F.col("fact"))
    joined = poison.join(f, F.col("query_id") == F.col("q"), "left")
    hit = F.coalesce(asserts(F.col("poison"), F.col("query"), F.col("fact")), F.lit(False))
    return joined.groupBy("query_id", "id").agg(F.max(hit).alias("survives"))


def gates(runs: DataFrame) -> DataFrame:
    """Totals and the verdict over runs (recall_found, recall_total, covered, facts,
    poison, negative, findings, usd, complete)."""
    n = F.count(F.lit(1))
    out = runs.agg(
        percent(F.sum("recall_found"), F.sum("recall_total")).alias("recall_pct"),
        percent(F.sum("covered"), F.sum("facts")).alias("coverage_pct"),
        F.sum("poison").alias("poison"),
        F.every(~F.col("negative") | (F.col("findings") == 0)).alias("negatives_clean"),
        F.round(F.sum("usd") / n, 6).alias("avg_usd"),
        F.every("complete").alias("complete"),
    )
    green = (F.col("recall_pct") >= 100) & (F.col("coverage_pct") >= 71.4) & (F.col("poison") == 0) & F.col("negatives_clean") & (F.col("avg_usd") < 0.15) & F.col("complete")
    return out.withColumns({"recall_pct": F.round("recall_pct", 6), "coverage_pct": F.round("coverage_pct", 6)}).withColumn("green", green)
