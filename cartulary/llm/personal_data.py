"""Personal data by fixed patterns and by contexts learnt from what these find, in DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import Saved, pick, small

#: Kinds in the order in which spans of one start are told.
KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct identifiers that a pattern must rest on; score from
#: which a pattern, and an identifier, counts (of 1,000).
ROUNDS, LEAST, TRUSTED = 4, 3, 500
#: Characters of text before a span that its pattern is taken from.
WINDOW = 64
#: Numbers whose running sums are built in one piece.
PIECE = 512
SPAN = "array<struct<start:int,end:int,value:string,pattern:string>>"


class Shape(NamedTuple):
    """What to look for: a text without any of the ``signs`` can't hold it."""

    signs: tuple[str, ...]
    regex: str


# The base patterns. A run of characters is taken whole (it could not match by giving
# some back) and entered at its start or where the last match ended, which finds
# the same places in time that grows with the text alone.
BASE = {
    "email": Shape(("@",), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": Shape((".",), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": Shape((), r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": Shape(("+",), r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Wider shapes that are personal data only where a learnt pattern stands before them.
WIDER = {
    "address": Shape(("@", "[at]", "(at)"), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)*+"),
    "number": Shape((), r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
    "groups": Shape((":",), r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+"),
}
#: Kinds that a wider shape may be, with the digits it must have.
MEANS = {"address": (("email", 0, 1 << 30),), "number": (("phone", 7, 15), ("card", 12, 19)), "groups": (("ip", 0, 1 << 30),)}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits' check sum holds; every second one from the end counts twice."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(2 * d % 10 + 2 * d // 10) for d in range(10)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match must fulfil besides; one that fails is dropped whole."""
    number = digits(value)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def running(steps: Column) -> Column:
    """Sums of an array's numbers up to each, built by pieces, so that a long array
    isn't copied once for each of its numbers."""
    from_zero = lambda xs: F.slice(F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, F.greatest(F.size(xs), F.lit(1)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE).cast("int")), lambda i: from_zero(F.slice(steps, i * PIECE + 1, F.lit(PIECE))))
    ends = F.aggregate(cut, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(x, -1))))
    return F.flatten(F.transform(F.arrays_zip(cut.alias("cut"), F.slice(ends, 1, F.size(cut)).alias("before")), lambda z: F.transform(z["cut"], lambda x: x + z["before"])))


def pattern_before(piece: Column) -> Column:
    """The two words before a span and what is glued to it, numbers made alike; empty
    if there is no whole word."""
    near = F.regexp_replace(F.regexp_replace(F.lower(F.right(piece, F.lit(WINDOW))), r"\s+", " "), "[0-9]+", "0")
    return F.regexp_extract(near, r"(?:^|(?<= ))((?:[^ ]{1,24} ){1,2}[^ ]{0,8})$", 1)


def spans(df: DataFrame, text: str, shapes: dict[str, Shape]) -> DataFrame:
    """Adds for each shape the array of its matches (start, end, value, pattern) in the
    text, leftmost first, without overlaps; places are code points."""
    hits = {n: pick(df.columns, f"_{n}_hits") for n in shapes}
    pieces = {n: pick(df.columns, f"_{n}_pieces") for n in shapes}

    def any_sign(shape: Shape) -> Column:
        out = F.lit(not shape.signs)
        for sign in shape.signs:
            out |= F.contains(F.col(text), F.lit(sign))
        return out

    def placed(name: str) -> Column:
        both = F.arrays_zip(F.col(hits[name]).alias("hit"), F.slice(pieces[name], 1, F.size(hits[name])).alias("piece"))
        ends = running(F.transform(both, lambda z: F.length(z["piece"]) + F.length(z["hit"])))
        all_ = F.arrays_zip(F.col(hits[name]).alias("hit"), F.col(pieces[name]).alias("piece"), ends.alias("end"))
        return F.transform(F.slice(all_, 1, F.size(hits[name])), lambda z: F.struct((z["end"] - F.length(z["hit"])).alias("start"), z["end"].alias("end"), z["hit"].alias("value"), pattern_before(z["piece"]).alias("pattern")))

    out = df.withColumns({hits[n]: F.when(any_sign(s), F.regexp_extract_all(text, F.lit(s.regex), F.lit(0))) for n, s in shapes.items()})
    out = out.withColumns({pieces[n]: F.when(F.size(hits[n]) > 0, F.split(text, s.regex, -1)) for n, s in shapes.items()})
    out = out.withColumns({n: F.when(F.col(pieces[n]).isNotNull(), placed(n)).otherwise(F.array().cast(SPAN)) for n in shapes})
    return out.drop(*hits.values(), *pieces.values())


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base, wider) of each row: ``key`` names its text; base spans (start,
    rank, end, kind, value, pattern) in order; wider ones (start, end, shape, value, pattern)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = spans(rows, "text", BASE | WIDER)

    def base(rank: int, kind: str) -> Column:
        fit = F.filter(kind, lambda s: valid(kind, s["value"]))
        return F.transform(fit, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), s["pattern"].alias("pattern")))

    def wider(shape: str) -> Column:
        return F.transform(shape, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(shape).alias("shape"), s["value"].alias("value"), s["pattern"].alias("pattern")))

    found = F.array_sort(F.concat(*[base(i, k) for i, k in enumerate(KINDS)]))
    return rows.select("id", F.unhex(F.sha2("text", 256)).alias("key"), found.alias("base"), F.concat(*map(wider, WIDER)).alias("wider"))


def same_form(kind: Column, value: Column) -> Column:
    """An identifier's value without the ways to write it."""
    return F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value))


def seeds(rows: DataFrame) -> DataFrame:
    """(kind, pattern, value) of base spans, each once."""
    each = rows.where(F.size("base") > 0).select(F.explode("base").alias("b")).where("b.pattern <> ''")
    return each.select("b.kind", "b.pattern", same_form(F.col("b.kind"), F.col("b.value")).alias("value")).distinct()


def unknown(rows: DataFrame) -> DataFrame:
    """(key, start, end, kind, pattern, value): wider spans that touch no base span, once for each
    text and kind that they may be."""
    near = rows.where("size(wider) > 0")
    mine = near.select("key", F.explode("wider").alias("w")).select("key", "w.*").where("pattern <> ''")
    mine = mine.distinct()
    taken = near.where("size(base) > 0").select("key", F.explode("base").alias("b")).select("key", "b.start", "b.end").distinct()
    both = mine.withColumn("wide", F.lit(True)).unionByName(taken.withColumn("wide", F.lit(False)), allowMissingColumns=True)
    by_start = lambda order: Window.partitionBy("key").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)  # noqa: E731  # one text's spans
    # base spans that begin before a wide one and reach into it, or begin inside it
    before = F.max(F.when(~F.col("wide"), F.col("end"))).over(by_start(F.asc("start")))
    after = F.min(F.when(~F.col("wide"), F.col("start"))).over(by_start(F.desc("start")))
    free = both.withColumn("reach", before).withColumn("next", after)
    free = free.where("wide and (reach is null or reach <= start) and (next is null or next >= end)")
    n = F.length(digits(F.col("value")))
    kinds = F.array_compact(F.array(*[F.when((F.col("shape") == shape) & n.between(lo, hi), F.lit(kind)) for shape, means in MEANS.items() for kind, lo, hi in means]))
    each = free.select("key", "start", "end", "pattern", "value", F.explode(kinds).alias("kind"))
    return each.withColumn("value", same_form(F.col("kind"), F.col("value")))


def scored(known: DataFrame, open_: DataFrame, saved: Saved, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, identifiers) with scores of 1,000 at most, from the graph of which
    pattern stands before which identifier.

    A seed's score is 1,000 throughout.  A pattern's is the mean of the identifiers
    that it stands before, one that is no identifier counted besides, if LEAST of them count
    at least TRUSTED; another identifier's is that of its best pattern.  Each round
    goes from patterns to identifiers and back, until none is new.
    """
    marked = known.withColumn("seed", F.lit(1000)).unionByName(open_.select("kind", "pattern", "value").withColumn("seed", F.lit(0)))
    edges = saved.write(marked.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")))
    fixed = edges.groupBy("kind", "value").agg(F.max("seed").alias("score"))
    values, count = saved.write(fixed), None
    for at in range(rounds):
        weighed = edges.drop("seed").join(small(values), ["kind", "value"])
        good = F.sum(F.when(F.col("score") >= TRUSTED, 1).otherwise(0))
        patterns = weighed.groupBy("kind", "pattern").agg(F.floor(F.sum("score") / (F.count(F.lit(1)) + 1)).cast("int").alias("score"), good.alias("good"))
        patterns = saved.write(patterns.where((F.col("good") >= LEAST) & (F.col("score") >= TRUSTED)).select("kind", "pattern", "score"))
        best = edges.join(small(patterns), ["kind", "pattern"], "left").groupBy("kind", "value").agg(F.greatest(F.max("seed"), F.coalesce(F.max("score"), F.lit(0))).alias("score"))
        values = saved.write(best)
        now = values.where(F.col("score") >= TRUSTED).count()
        if now == count:
            break
        count = now
    return patterns, values


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, base, spans) of each row: what the base patterns find, and with it what
    learnt contexts add, both arrays of (start, rank, end, kind) in order.

    Base spans are the seeds.  The words before them make patterns, patterns and
    identifiers score each other over all texts, and a span of a wider shape becomes
    personal data where its identifier earns TRUSTED from a pattern that at least LEAST known
    identifiers follow.  Copies of a text count once in the scores and get the same
    spans.  Texts are read once and never shuffled; spans meet rows by the text's hash.

    A null or empty text has no spans; repeated rows are rows of their own; an empty
    table gives none; other columns of ``docs`` don't matter.
    """
    saved = Saved(spark)
    rows = saved.write(scanned(docs, id_col, text_col))
    open_ = saved.write(unknown(rows))
    _, values = scored(seeds(rows), open_, saved, rounds)
    named = open_.join(small(saved.write(values.where(F.col("score") >= TRUSTED))), ["kind", "value"])
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    one = named.withColumn("rank", rank).groupBy("key", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "kind")).alias("best"))
    more = one.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("start", "best.rank", "end", "best.kind")).alias("more"))
    joined = rows.select("id", "key", F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in ("start", "rank", "end", "kind")])).alias("base")).join(more, F.col("key") == F.col("of"), "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select(F.col("id").alias(id_col), "base", every.alias("spans"))


def told(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
