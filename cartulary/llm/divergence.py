"""Audit of how sources diverge in their words: two passes over the texts, then sparse postings."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import Saved, small

#: Documents that a kept term stands in, at least; ranks of terms that are told.
LEAST_DOCS, RANKS = 3, 200
#: A probability of one, and what is added to each count.
UNIT, PLUS = 1_000_000_000, 1
#: Most terms of the broadcast automaton and most bytes of one of them, which bounds it;
#: counts that a task holds before it hands them on.
AUTOMATON, AUTOMATON_BYTES, HELD = 200_000, 64, 500_000
#: Bytes of UTF-8 as the terms see them: A-Z lower-cased, what no term has as a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def documents_with(batches: Iterable[pa.RecordBatch], held: dict, merge: Callable, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Merges each document, its text the last column, into ``held`` (counters by the columns
    before) and hands them on when they hold HELD entries, and at the end."""
    size = 0
    for batch in batches:
        *groups, texts = (batch.column(c).to_pylist() for c in batch.schema.names)
        # group by group, so that a counter and its language's words stay at hand
        for group, text in sorted(zip(zip(*groups), texts), key=lambda row: row[0]):
            counter = held[group]
            before = len(counter)
            merge(counter, text.translate(FOLD))
            size += len(counter) - before
            if size > HELD:
                yield emit(held)
                held.clear()
                size = 0
    if size:
        yield emit(held)


def document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, term, n), the task's documents that hold each term."""
    return documents_with(batches, defaultdict(Counter), lambda counter, text: counter.update(set(text.split())), rows_of)


def group_columns(held: dict[tuple[str, ...], Counter]) -> list[pa.Array]:
    """The groups' columns, each group as often as its counter has entries."""
    at = pa.array(np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for c in held.values()]))
    return [pa.DictionaryArray.from_arrays(at, pa.array(c, pa.string())).cast(pa.string()) for c in zip(*held)]


def chained(held: dict[tuple[str, ...], Counter]) -> tuple[list, np.ndarray]:
    keys: list = []
    for counter in held.values():
        keys += counter
    return keys, np.fromiter((n for counter in held.values() for n in counter.values()), np.int64, len(keys))


def rows_of(held: dict[tuple[str, ...], Counter]) -> pa.RecordBatch:
    keys, n = chained(held)
    return pa.RecordBatch.from_arrays([*group_columns(held), pa.array(keys, pa.binary()), pa.array(n)], names=["lang", "term", "n"])


def numbered_rows_of(held: dict[tuple[str, ...], Counter]) -> pa.RecordBatch:
    """Rows that give a listed term by its number, and another word as it is."""
    keys, n = chained(held)
    number = np.fromiter((k if k.__class__ is int else -1 for k in keys), np.int32, len(keys))
    words = pa.array([None if k.__class__ is int else k for k in keys], pa.binary())
    return pa.RecordBatch.from_arrays([*group_columns(held), pa.array(number), words, pa.array(n)], names=["lang", "source", "number", "word", "n"])


class Automaton:
    """Finds listed terms in folded texts; what lies between the finds are other words.

    Terms are padded by the delimiter on both sides, so only whole words match, and
    neighbours share one.  Texts are taken byte for byte.
    """

    _made: Automaton | None = None

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.terms = terms
        self.found = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.found.add_word(f" {term.decode('latin-1')} ", (i, len(term) + 1))
        self.found.make_automaton()

    @classmethod
    def of(cls, listed: Broadcast) -> Automaton:
        """A worker's own one, made once for a list."""
        if cls._made is None or cls._made.terms is not listed.value:
            cls._made = cls(listed.value)
        return cls._made

    def count(self, text: bytes, beside: bool = True) -> tuple[list[int], list[bytes]]:
        """Numbers of the listed terms that occur, and the words ``beside`` them if these are wanted."""
        padded = f" {text.decode('latin-1')} "
        if not beside:
            return [i for _, (i, _) in self.found.iter(padded)] if self.terms else [], []
        hits, others, to = [], [], 0
        if self.terms:
            for end, (i, back) in self.found.iter(padded):
                hits.append(i)
                if end - back > to:
                    others += padded[to : end - back].split(" ")
                to = end
        others += padded[to:].split(" ")
        return hits, [w.encode("latin-1") for w in others if w]


def occurrences(listed: Broadcast, beside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: (lang, source, number, word, n) of the task's documents, by the
    automaton of the ``listed`` terms, which go by their numbers; ``beside`` tells whether
    a kept term may be among the other words, which are then counted too, with number -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(listed)

        def merge(counter: Counter, text: bytes) -> None:
            hits, others = automaton.count(text, beside)
            counter.update(hits)
            counter.update(others)

        return documents_with(batches, defaultdict(Counter), merge, numbered_rows_of)

    return run


def commonest(kept: DataFrame, most: int) -> list[bytes]:
    """The terms of highest document frequency for the automaton, ``most`` at most.

    They are those above a frequency that counts by size class give, so no task
    sorts the vocabulary and the driver gets a bounded list.
    """
    by_term = kept.where(F.octet_length("term") <= AUTOMATON_BYTES).groupBy("term").agg(F.sum("df").alias("df"))
    size = F.floor(F.log2("df") * 16)
    left, least = most, None
    for r in by_term.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundreds of classes
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    return [] if least is None else sorted(bytes(r["term"]) for r in by_term.where(size >= least).select("term").collect())


def all_listed(kept: DataFrame, listed: list[bytes]) -> bool:
    return kept.select("term").distinct().count() == len(listed)


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + PLUS) / (total + PLUS * v)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(n + PLUS), whole(total + v * PLUS))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly."""
    return F.call_function("div", (p - q) * (p - q), q)


def postings(spark: SparkSession, docs: DataFrame, saved: Saved, automaton: int = AUTOMATON) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, group postings, lang postings) as written tables.

    groups: (lang, source, v, total, size, p0): kept terms of the lang, occurrences and
    terms of the group, probability of a kept term that the group lacks.
    Postings: (lang, source, term, n, p) and (lang, term, q) of occurring kept terms.
    """
    part = docs.withColumn("text", F.col("text").cast("binary"))
    df = part.select("lang", "text").mapInArrow(document_frequencies, "lang string, term binary, n long")
    kept = saved.write(df.groupBy("lang", "term").agg(F.sum("n").alias("df")).where(F.col("df") >= LEAST_DOCS))
    listed = commonest(kept, automaton)
    found = part.select("lang", "source", "text").mapInArrow(occurrences(spark.sparkContext.broadcast(listed), not all_listed(kept, listed)), "lang string, source string, number int, word binary, n long")
    numbers = saved.write(spark.createDataFrame(pa.table({"term": pa.array(listed, pa.binary()), "number": pa.array(range(len(listed)), pa.int32())})))
    summed = found.groupBy("lang", "source", "number", "word").agg(F.sum("n").alias("n")).join(small(numbers), "number", "left")
    counts = summed.select("lang", "source", F.coalesce("term", "word").alias("term"), "n").join(small(kept), ["lang", "term"], "left_semi")
    counts = saved.write(counts)
    sizes = saved.write(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")))
    groups = docs.select("lang", "source").distinct().join(small(sizes), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "size"])
    groups = saved.write(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))))
    posts = counts.join(small(groups.select("lang", "source", "v", "total")), ["lang", "source"])
    posts = saved.write(posts.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p")))
    whole = saved.write(groups.groupBy("lang").agg(F.max("v").alias("v"), F.sum("total").alias("total")))
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(small(whole), "lang")
    langs = saved.write(langs.select("lang", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("q")))
    return groups, posts, langs


def both_ways(sums: DataFrame) -> DataFrame:
    """(lang, source, item, value): ``x`` from source to o_source and ``y`` back, from one
    pass over ``sums``; a union would work them out twice."""
    one = F.struct("source", F.col("o_source").alias("item"), F.col("x").cast("decimal(38,0)").alias("value"))
    back = F.struct(F.col("o_source").alias("source"), F.col("source").alias("item"), F.col("y").cast("decimal(38,0)").alias("value"))
    return sums.select("lang", F.explode(F.array(one, back)).alias("way")).select("lang", "way.*")


def pairs(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a lang, in both orders.

    A value sums over all kept terms, but only postings are touched: terms that
    neither source has count by number, terms that one has by a histogram of its
    probabilities against the other's constant, and a self-join of the postings
    corrects for terms that both have.
    """
    g = groups.where("v > 0").select("lang", "source", "v", "size", "p0")
    a, b = g.alias("a"), g.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "size", "p0")])
    own = lambda v: v.cast("decimal(38,0)").alias("value")
    other = F.col("source") != F.col("o_source")
    neither = a.join(b, "lang").where(other).select("lang", "source", F.col("o_source").alias("item"), own((F.col("v") - F.col("size") - F.col("o_size")) * apart(F.col("p0"), F.col("o_p0"))))
    hist = posts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    each = hist.join(b, "lang").where(other)
    mine = each.groupBy("lang", "source", "o_source").agg(F.sum(F.col("c") * apart(F.col("p"), F.col("o_p0"))).alias("x"), F.sum(F.col("c") * apart(F.col("o_p0"), F.col("p"))).alias("y"))
    single = both_ways(mine)
    known = posts.join(small(g.select("lang", "source", "p0")), ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    also = known.select("lang", "term", *[F.col(c).alias(f"o_{c}") for c in ("source", "p", "p0")])
    both = known.join(also, ["lang", "term"]).where(F.col("source") < F.col("o_source"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "o_p", "o_p0"))
    shared = both.groupBy("lang", "source", "o_source").agg(
        F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("x"),
        F.sum(apart(q, p) - apart(q0, p) - apart(q, p0) + apart(q0, p0)).alias("y"),
    )
    met = both_ways(shared)
    empty = groups.where("v = 0").select("lang", "source").alias("a").join(groups.where("v = 0").select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return neither.unionByName(single).unionByName(met).unionByName(empty.withColumn("value", own(F.lit(0)))).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", ranks: int = RANKS, automaton: int = AUTOMATON) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ.

    Part ``pair`` ranks the other sources of the lang by their chi-square-like distance
    over all kept terms; part ``term`` the group's overused terms against the lang.
    The first pass counts the documents of each term of each lang; the second counts
    occurrences by an automaton of the commonest kept terms, of bounded size, while
    other words are counted as they are and meet the kept terms in a join, so the
    vocabulary may be of any size.  No text leaves its task.

    Null text, lang and source are ''.  A lang without kept terms has pairs of value 0
    and no terms; a lang with one source has no pairs.  Repeated rows are documents of their
    own; an empty table gives no rows; other columns don't matter.
    """
    saved = Saved(spark)
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups, posts, langs = postings(spark, known, saved, automaton)
    over = posts.join(langs, ["lang", "term"]).where(F.col("p") > F.col("q"))
    terms = over.select("lang", "source", F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs(groups, posts), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))
