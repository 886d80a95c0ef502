"""Chunks: line ranges of candidate files, scored and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import fixed, paths, skeleton
from cartulary.functions.text import ascii_lower, lines, numbered, occurrences, terms

MODES = ("fixed", "boundary", "boundary_overlap", "boundary_split")


def bounds(rows: Column, text: Column, adapter: Column, mode: str, window: int, overlap: int) -> Column:
    """Array of (first, last), lines from 1, of a text's chunks.

    ``fixed``: every ``window`` lines.  ``boundary``: from line 1 and each heading
    of prose or symbol of code to the next, but no further than ``window`` lines;
    ``boundary_overlap`` reads ``overlap`` lines on.  ``boundary_split``, unlike
    these, cuts a longer section into several chunks and loses no line.  ``rows``
    are the text's lines, as a column of their own.  All headings and symbols count,
    not only those that a card keeps.
    """
    n = F.size(rows)
    if mode == "fixed":
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(window)))
        spans = F.transform(starts, lambda s: F.struct((s + 1).alias("first"), F.least(s + window, n).alias("last")))
        return F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>"))
    heads = F.transform(F.filter(skeleton.outline(text, None), lambda h: h["line"] > 1), lambda h: h["line"] - 1)
    marks = F.transform(F.filter(skeleton.code_symbols(text, None), lambda s: s["line"] > 1), lambda s: s["line"] - 1)
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.when(paths.is_prose(adapter), heads).otherwise(marks))))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    pairs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"] > p["a"])
    if mode == "boundary_split":
        cut = F.transform(pairs, lambda p: F.transform(F.sequence(p["a"], p["b"] - 1, F.lit(window)), lambda s: F.struct((s + 1).alias("first"), F.least(s + window, p["b"]).alias("last"))))
        return F.when(n > 0, F.flatten(cut)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    more = overlap if mode == "boundary_overlap" else 0
    spans = F.transform(pairs, lambda p: F.struct((p["a"] + 1).alias("first"), F.least(F.least(p["b"], p["a"] + window) + more, n).alias("last")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def chunks(files: DataFrame, mode: str = "boundary_overlap", window: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """``files`` (path, text, adapter, ...) as chunks: first_line, last_line and the
    numbered ``body``; a file without lines has none."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    keep = [c for c in files.columns if c != "text"]
    split = files.withColumn("_lines", lines(F.col("text")))
    span = F.explode_outer(bounds(F.col("_lines"), F.col("text"), F.col("adapter"), mode, window, overlap)).alias("span")
    cut = split.select(*keep, "_lines", span).where("span is not null")
    rows = F.slice("_lines", F.col("span.first"), F.col("span.last") - F.col("span.first") + 1)
    return cut.select(*keep, F.col("span.first").alias("first_line"), F.col("span.last").alias("last_line"), numbered(rows, F.col("span.first")).alias("body"))


def chunk_score(body: Column, score: Column, router_rank: Column, look_for: Column, query: str) -> Column:
    """The file's score, 2 and the count for each term that the body holds, 5 for a
    router's rank of 3 or less; a term of both query and hint counts twice."""
    wanted = F.concat(terms(F.lit(query)), terms(F.coalesce(look_for, F.lit(""))))
    start = F.struct(ascii_lower(body).alias("low"), F.lit(0.0).alias("sum"))

    def step(s: Column, t: Column) -> Column:
        n = occurrences(s["low"], t)
        return F.struct(s["low"].alias("low"), (s["sum"] + F.when(n > 0, n + 2.0).otherwise(0.0)).alias("sum"))

    found = F.aggregate(wanted, start, step, lambda s: s["sum"])
    return score + found + F.when(router_rank <= 3, 5.0).otherwise(0.0)


def rank_chunks(chunks_: DataFrame, query: str, cap: int = fixed.CHUNK_CAP) -> DataFrame:
    """At most ``cap`` chunks: the best of each file first, then the best of the rest.

    ``chunks_`` has (path, first_line, body, score, router_rank, look_for) of the
    candidate files, whose number is bounded; so is what the last sort sees.
    """
    scored = chunks_.withColumn("chunk_score", chunk_score(F.col("body"), F.col("score"), F.col("router_rank"), F.col("look_for"), query))
    own = Window.partitionBy("path").orderBy(F.desc("chunk_score"), "first_line")
    best = scored.withColumn("is_best", F.row_number().over(own) == 1)
    return best.orderBy(F.desc("is_best"), F.desc("chunk_score"), "path", "first_line").limit(cap).drop("is_best")


def in_order(chunks_: DataFrame) -> DataFrame:
    return chunks_.orderBy(F.asc_nulls_last("router_rank"), F.desc("score"), "path", "first_line")


def lexical_top(chunks_: DataFrame, query_terms: list[str], most: int = 12) -> DataFrame:
    """Chunks with most distinct terms at beginnings of words, then most hits."""
    low = F.lower("body")
    hits = [F.regexp_count(low, F.lit(rf"(?U)\b{t}")) for t in query_terms]
    zero = F.lit(0)
    distinct = sum((F.when(h > 0, 1).otherwise(0) for h in hits), zero)
    counted = chunks_.withColumn("distinct_hits", distinct).withColumn("total_hits", sum(hits, zero))
    return counted.where("distinct_hits > 0").orderBy(F.desc("distinct_hits"), F.desc("total_hits"), "path", "first_line").limit(most)


def admitted(units: DataFrame, cost: str, cap: float, order: list[str], out: str = "admitted") -> DataFrame:
    """Which units start before their running cost is over ``cap``; once one is
    refused so are all after it.  For a query's chunks, whose number is capped."""
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn(out, F.round(F.sum(cost).over(run), 9) <= cap)
