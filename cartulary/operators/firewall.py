"""The firewall: only findings whose quote stands at its line pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import let, lines, running_sums, squeeze, strings, terms, without_emphasis


def flattened(text: Column, strip=lambda c: c) -> Column:
    """(flat, ends): a text's squeezed lines joined by single spaces, and where each ends,
    the space behind it counted; once a file, for all quotes."""
    form = lambda rows: F.struct(F.array_join(rows, " ").alias("flat"), running_sums(F.transform(rows, lambda r: F.length(r) + 1)).alias("ends"))
    return let(F.transform(lines(text), lambda s: squeeze(strip(s))), form)


def line_of(flat: Column, quote: Column, strip=lambda c: c) -> Column:
    """Line, from 1, at which the squeezed quote first begins; null if it doesn't.

    Its place is looked up among the lines' ends by halving.
    """
    at, n = F.instr(flat["flat"], squeeze(strip(quote))), F.size(flat["ends"])
    span = F.struct(at.alias("at"), F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.element_at(flat["ends"], mid + 1) < s["at"]
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(s["at"].alias("at"), F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)
    return F.when(at > 0, F.aggregate(steps, span, halve, lambda s: s["lo"] + 1))


def near(found: Column, line: Column) -> Column:
    return F.coalesce(F.abs(found - line) <= fixed.LINE_TOLERANCE, F.lit(False))


def blank(text: Column) -> Column:
    return squeeze(F.coalesce(text, F.lit(""))) == ""


def verify(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` (path, line, fact, quote, ...) with their ``verdict``: the tier
    ("exact" or "markdown_normalized") of one that holds, else why not.

    Files join on the path by whatever way Spark finds best, and each is flattened once
    before that, whatever the number of its findings; the second tier's form is made of
    prose alone.  A query's few findings need the files alone that it looked into: hand
    in no more, lest all texts be dealt out for them.
    """
    text, quote, line, plain, bare = (F.col(c) for c in ("text", "quote", "line", "_plain", "_bare"))
    prose, marked = F.col("adapter") == "markdown", text.rlike("[*_`~]")
    # without marks of emphasis both forms are one
    ready = files.where(text.isNotNull()).select("path", flattened(text).alias("_flat"), F.when(prose & marked, flattened(text, without_emphasis)).alias("_free"), (prose & ~marked).alias("_same"))
    joined = findings.join(ready, "path", "left")
    said = F.col("_flat").isNotNull() & ~blank(quote)
    first = joined.withColumn("_plain", F.when(said, line_of(F.col("_flat"), quote)))
    free = F.when(F.col("_same"), F.col("_flat")).otherwise(F.col("_free"))
    again = (F.col("_same") | F.col("_free").isNotNull()) & ~near(plain, line) & said
    second = first.withColumn("_bare", F.when(again, line_of(free, quote, without_emphasis)))
    missed = lambda at: F.concat(F.lit("line_mismatch:"), at.cast("string"))
    verdict = (
        F.when(F.col("_flat").isNull(), "file_missing")
        .when(blank(quote) | blank(F.col("fact")), "empty")
        .when(near(plain, line), "exact")
        .when(near(bare, line), "markdown_normalized")
        .when(bare.isNotNull(), missed(bare))
        .when(plain.isNotNull(), missed(plain))
        .otherwise("quote_not_in_file")
    )
    return second.withColumn("verdict", verdict).drop("_flat", "_free", "_same", "_plain", "_bare")


def passed(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("verdict").isin("exact", "markdown_normalized")).withColumnRenamed("verdict", "match_tier")


def dropped(verified: DataFrame) -> DataFrame:
    return verified.where(~F.col("verdict").isin("exact", "markdown_normalized")).withColumnRenamed("verdict", "reason")


def drop_counts(dropped_: DataFrame) -> DataFrame:
    return dropped_.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def claim_terms(query: Column) -> Column:
    """Terms that a quote must hold if the query asks where something is said; null otherwise."""
    bare = F.trim(F.regexp_replace(F.trim(query), "[?.!]+$", ""))
    rest = F.substring(bare, len(fixed.CLAIM_PREFIX) + 1, 1 << 30)
    needed = F.array_except(terms(rest), strings(fixed.CLAIM_WORDS))
    return F.when(F.lower(bare).startswith(fixed.CLAIM_PREFIX) & (F.size(needed) >= 3), needed)


def holds_claim(query: Column, quote: Column) -> Column:
    needed = claim_terms(query)
    return needed.isNull() | (F.size(F.array_except(needed, terms(F.coalesce(quote, F.lit(""))))) == 0)


def in_order(findings: DataFrame) -> list[Column]:
    """Sort keys of findings: rank, score, path, line."""
    return [F.asc_nulls_last("router_rank"), F.desc("score"), F.asc("path"), F.asc("line")]


def distinct(findings: DataFrame, *of: str) -> DataFrame:
    """Each path, line and quote once, or once for each value of ``of``."""
    return findings.dropDuplicates([*of, "path", "line", "quote"])
