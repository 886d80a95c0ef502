"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import pick
from cartulary.llm.license_rules import ANCHORS, BASE, BASE_SCORE, CC_BY, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of characters that no word has, of lower-cased text; words of raw text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Stands before a match's first word; no word has it.
MARK = "\u0001"
GROUPS = "array<array<struct<label:string,pattern:string,priority:int,score:double>>>"


def normalised(text: Column) -> Column:
    """Lower-cased words, each between two single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def anchored(text: Column, low: Column) -> Column:
    """Whether a raw text (``low``: lower-cased) may hold a match of any rule at all."""
    out = F.contains(low, F.lit("cc")) & F.rlike(text, F.lit(CC_BY))
    for word in ANCHORS:
        out = F.contains(low, F.lit(word)) | out
    return out


def by_keyword(all_rules: list[Rule]) -> list[tuple[str, list[Rule]]]:
    return [(k, list(rs)) for k, rs in groupby(sorted(all_rules, key=lambda r: r.keyword), lambda r: r.keyword)]


def grouped(all_rules: list[Rule]) -> Column:
    """Rules by keyword, as one literal."""
    found = [[{"label": r.label, "pattern": whole(r.pattern), "priority": r.priority, "score": r.score} for r in rs] for _, rs in by_keyword(all_rules)]
    return F.from_json(F.lit(json.dumps(found)), GROUPS)


def starts(norm: Column, pattern: Column) -> Column:
    """Numbers of the words at which matches start, from 0."""
    marked = F.split(F.trim(F.regexp_replace(norm, pattern, F.concat(F.lit(MARK), F.lit("$0")))), " ")
    return F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())


def detections(norm: Column, all_rules: list[Rule]) -> Column:
    """(start, minus end, minus priority, label, score) of every match, sorted.

    A group's rules are tried one by one only where its keyword stands and one
    pattern of them all matches: that one is a literal, which is compiled once.
    """
    any_of = [F.contains(norm, F.lit(f" {k} ")) & F.rlike(norm, F.lit(whole("|".join(r.pattern for r in rs)))) for k, rs in by_keyword(all_rules)]
    near = F.filter(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(any_of)]), lambda i: i.isNotNull())
    fits = F.flatten(F.transform(near, lambda i: F.filter(F.get(grouped(all_rules), i), lambda r: F.rlike(norm, r["pattern"]))))

    def places(r: Column) -> Column:
        found = F.arrays_zip(starts(norm, r["pattern"]).alias("at"), F.regexp_extract_all(norm, r["pattern"], F.lit(0)).alias("hit"))
        return F.transform(found, lambda z: F.struct(z["at"].alias("start"), (-(z["at"] + F.size(F.split(z["hit"], " ")))).alias("end"), (-r["priority"]).alias("priority"), r["label"].alias("label"), r["score"].alias("score")))

    return F.array_sort(F.flatten(F.transform(fits, places)))


def surviving(found: Column, top: int) -> Column:
    """(labels, score) of the detections that no other one suppresses.

    One within another's words, or on the same words, falls if the other has as
    high a priority and, of equals, comes first.  In the sorted order whatever
    holds a detection stands before it, so the furthest end of each priority up
    to there is all that has to be known: one pass, whatever the number.
    """
    none = F.struct(F.array_repeat(F.lit(0), top).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(have: Column, d: Column) -> Column:
        over = F.array_max(F.slice(have["ends"], -d["priority"], F.lit(top) + d["priority"] + 1)) >= -d["end"]
        ends = F.transform(have["ends"], lambda e, p: F.when(p + 1 == -d["priority"], F.greatest(e, -d["end"])).otherwise(e))
        more = F.struct(ends.alias("ends"), F.array_union(have["labels"], F.array(d["label"])).alias("labels"), F.greatest(have["score"], d["score"]).alias("score"))
        return F.when(over, have).otherwise(more)

    return F.aggregate(found, none, step)


def scan(docs: DataFrame, text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with what its texts say of licenses; no shuffle, a row stays a row.

    New columns: ``n_words``; ``base`` (sorted numbers of the words at which a
    base phrase starts); ``base_labels`` and ``labels`` (sorted arrays; the latter
    with the labels of the rules' surviving detections); ``detections`` (label,
    start, end and priority of each match); ``score``, the best score, 0 if there
    is none.  A null or empty text has no words and empty arrays; repeated rows
    get equal results; an empty table gives none; columns of ``docs`` with these
    names are replaced.  Texts without an anchor are only counted.
    """
    all_rules = rules() if all_rules is None else all_rules
    top = max((r.priority for r in all_rules), default=1)
    text, norm, hits, left, base = (F.col(text_col), *(F.col(pick(docs.columns, f"_{c}")) for c in ("norm", "hits", "left", "base")))
    name = {c: pick(docs.columns, f"_{c}") for c in ("low", "norm", "hits", "left", "base")}
    near = docs.withColumn(name["low"], F.lower(text))
    near = near.withColumn(name["norm"], F.when(anchored(text, F.col(name["low"])), normalised(text)))
    rows = near.withColumn(name["hits"], F.when(norm.isNotNull(), detections(norm, all_rules)))
    each = F.array(*[F.struct(F.lit(label).alias("label"), starts(norm, F.lit(whole(phrase))).alias("at")) for label, phrase in BASE])
    rows = rows.withColumn(name["base"], F.when(norm.isNotNull(), each))
    rows = rows.withColumn(name["left"], F.when(F.size(hits) > 0, surviving(hits, top)))
    at = F.coalesce(F.array_sort(F.flatten(F.transform(base, lambda b: b["at"]))), F.array().cast("array<int>"))
    own = F.coalesce(F.array_sort(F.transform(F.filter(base, lambda b: F.size(b["at"]) > 0), lambda b: b["label"])), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(own, F.coalesce(left["labels"], F.array().cast("array<string>"))))
    spans = F.transform(hits, lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["end"]).alias("end"), (-d["priority"]).alias("priority")))
    score = F.greatest(F.coalesce(left["score"], F.lit(0.0)), F.when(F.size(own) > 0, F.lit(BASE_SCORE)).otherwise(0.0))
    out = {"n_words": F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long"), "base": at, "base_labels": own, "labels": labels, "detections": F.coalesce(spans, F.array().cast("array<struct<label:string,start:int,end:int,priority:int>>")), "score": score}
    return rows.withColumns(out).drop(*name.values())
