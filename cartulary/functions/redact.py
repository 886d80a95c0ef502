"""Redaction: secrets and addresses replaced by numbered placeholders, as one expression.

Numbers run through a text in order of the passes and repeat with their literal: an
ordered fold over each pass's matches carries the literals' placeholders.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import is_known_harmless, let, looks_random, trimmed

# Fixed values. Patterns of the public contract; groups are what stays, the value, what stays.
HOME = r"/(?:Users|home)/[A-Za-z0-9._-]+/"
BEARER = r"\b(Bearer\s+)([A-Za-z0-9._~+/-]{12,}=*)"
WORDS = ("key", "token", "secret", "password", "api", "credential", "auth")
WORDY = r"[A-Za-z0-9_.-]*(?:key|token|secret|password|api|credential|auth)[A-Za-z0-9_.-]*"
PAIRS = (
    rf"""(?i)(["'][^"'\n]*{WORDY}[^"'\n]*["']\s*:\s*["'])([^"'\n]+)(["'])""",
    rf"""(?i)(\b{WORDY}\s*=\s*["']?)([^"'\s#;]+)""",
    r"(?i)(--[A-Za-z0-9_-]*(?:key|token|secret|password|api|credential|auth)[A-Za-z0-9_-]*\s+)([^\s]+)",
    rf"""(?im)(^\s*["']?{WORDY}["']?\s*:\s*["']?)([^\n"',}}]+)""",
)
TOKENS = (
    r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    (
        r"(?:sk-ant-[A-Za-z0-9._-]{8,}|sk-[A-Za-z0-9._-]{8,}|csk-[A-Za-z0-9._-]{8,}|AKIA[0-9A-Z]{12,20}"
        r"|ghp_[A-Za-z0-9_]{8,}|github_pat_[A-Za-z0-9_]{20,}|gho_[A-Za-z0-9_]{8,}|ghu_[A-Za-z0-9_]{8,}"
        r"|glpat-[A-Za-z0-9_-]{8,}|npm_[A-Za-z0-9_-]{8,}|pypi-[A-Za-z0-9_-]{8,}|xox[bpars]-[A-Za-z0-9-]{8,})"
    ),
)
RUN = r"[A-Za-z0-9+/=_-]{32,}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

#: Classes, borders and case by Unicode; lines end at a line feed alone.
FLAGS = "(?Ud)"
#: What is spared in a pass: nothing, values known to be harmless, runs that don't look random.
NOTHING, HARMLESS, ORDERLY = range(3)
PASS = "struct<regex:string,kind:string,spared:int,signs:array<string>>"


def passes() -> Column:
    """The passes in their order, each with three groups: what stays, the value, what stays;
    a text that holds none of the ``signs``, lower-cased, can't match before a pass has put in a placeholder."""
    alone = lambda p: f"()({p})()"
    rows = [(BEARER + "()", "SECRET", NOTHING, ["bearer"])]
    rows += [(p if i == 0 else p + "()", "SECRET", HARMLESS, list(WORDS)) for i, p in enumerate(PAIRS)]
    rows += [(alone(TOKENS[0]), "SECRET", HARMLESS, ["eyj"]), (alone(TOKENS[1]), "SECRET", HARMLESS, ["sk-", "akia", "ghp_", "github_pat_", "gho_", "ghu_", "glpat-", "npm_", "pypi-", "xox"]), (alone(RUN), "SECRET", ORDERLY, []), (alone(EMAIL), "EMAIL", NOTHING, ["@"])]
    return F.from_json(F.lit(json.dumps([{"regex": FLAGS + p, "kind": k, "spared": x, "signs": s} for p, k, x, s in rows])), f"array<{PASS}>")


def named(acc: Column, hit: Column, one: Column) -> Column:
    """``acc`` (out, names, count) after a match: spared, or replaced by its literal's placeholder."""
    value = trimmed(hit["value"])
    size = F.when(one["kind"] == "EMAIL", "").otherwise(F.concat(F.lit(" len="), F.octet_length(value).cast("string")))
    new = F.concat(F.lit("[REDACTED_"), one["kind"], F.lit("_"), (F.size(F.map_keys(acc["names"])) + 1).cast("string"), size, F.lit("]"))
    names = F.when(F.map_contains_key(acc["names"], value), acc["names"]).otherwise(F.map_concat(acc["names"], F.create_map(value, new)))
    put = lambda text, names, n: F.struct(F.concat(acc["out"], F.array(text)).alias("out"), names.alias("names"), (acc["count"] + n).alias("count"))
    spared = ((one["spared"] == HARMLESS) & is_known_harmless(value)) | ((one["spared"] == ORDERLY) & ~looks_random(value))
    return F.when(spared, put(hit["whole"], acc["names"], F.lit(0))).otherwise(put(F.concat(hit["before"], F.coalesce(F.try_element_at(acc["names"], value), new), hit["after"]), names, F.lit(1)))


def after(state: Column, one: Column) -> Column:
    """``state`` (text, low, names, count) after a pass; ``low`` is the text as it was."""
    part = lambda i: F.regexp_extract_all(state["text"], one["regex"], F.lit(i))
    near = (state["count"] > 0) | (F.size(one["signs"]) == 0) | F.exists(one["signs"], lambda sign: F.contains(state["low"], sign))

    def fold(whole: Column) -> Column:
        hits = F.arrays_zip(whole.alias("whole"), part(1).alias("before"), part(2).alias("value"), part(3).alias("after"))
        begun = F.struct(F.array().cast("array<string>").alias("out"), state["names"].alias("names"), state["count"].alias("count"))

        def done(acc: Column) -> Column:
            between = F.split(state["text"], one["regex"], F.lit(-1))
            text = F.array_join(F.zip_with(between, F.concat(acc["out"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            return F.struct(text.alias("text"), state["low"].alias("low"), acc["names"].alias("names"), acc["count"].alias("count"))

        return F.aggregate(hits, begun, lambda acc, hit: named(acc, hit, one), done)

    none = F.array().cast("array<string>")
    return let(F.when(near, part(0)).otherwise(none), lambda whole: F.when(F.size(whole) == 0, state).otherwise(fold(whole)))


def redact(text: Column) -> Column:
    """(text, count): the redacted text and how many values were replaced; null stays
    null with count 0.

    A home directory's name goes uncounted; then bearer tokens, values of telling keys,
    tokens of known shapes, long random runs and e-mail addresses.
    """
    return let(text, folded)


def folded(text: Column) -> Column:
    home = F.when(text.contains("/home/") | text.contains("/Users/"), F.regexp_replace(text, HOME, "~/")).otherwise(text)
    low = F.lower(F.replace(text, F.lit("ſ"), F.lit("s")))  # an s to the patterns
    begun = F.struct(home.alias("text"), low.alias("low"), F.create_map().cast("map<string,string>").alias("names"), F.lit(0).cast("long").alias("count"))
    done = F.aggregate(F.when(text.isNotNull(), passes()), begun, after, lambda s: F.struct(s["text"].alias("text"), s["count"].alias("count")))
    return F.coalesce(done, F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("count")))
