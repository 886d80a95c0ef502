"""Text functions as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.fixed import STOP_WORDS, SUFFIXES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strings(values) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def stem(word: Column) -> Column:
    """Without the first ending that leaves three letters."""
    out = word
    for suffix in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) >= len(suffix) + 3)
        out = F.when(fits, F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Distinct stems of the words that count, in order of first occurrence."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem))


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trimmed(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_emphasis(text: Column) -> Column:
    return F.translate(text, "*_`~", "")


def lines(text: Column) -> Column:
    """Lines as an array; a line break at the end starts no further line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Numbers whose running sums are built in one piece.
PIECE = 512


def running_sums(steps: Column) -> Column:
    """Sums of an array's numbers up to each one.

    They are built by pieces, so that a long array isn't copied for each of its numbers.
    """
    grown = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    piece = lambda xs: F.slice(F.aggregate(xs, F.array(F.lit(0)), grown), 2, F.greatest(F.size(xs), F.lit(1)))

    def joined(pieces: Column) -> Column:
        begun = F.aggregate(pieces, F.array(F.lit(0)), lambda a, xs: grown(a, F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))))
        return F.flatten(F.zip_with(pieces, F.slice(begun, 1, F.size(pieces)), lambda xs, b: F.transform(xs, lambda x: x + b)))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / PIECE).cast("int"), F.lit(0))), lambda i: piece(F.slice(xs, i * PIECE + 1, F.lit(PIECE))))
    return let(steps, lambda xs: let(cut(xs), joined))


def numbered(rows: Column, first: Column) -> Column:
    """Lines with their numbers, as one text."""
    return F.array_join(F.transform(rows, lambda line, i: F.concat((i + first).cast("string"), F.lit("| "), line)), "\n")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def occurrences(text: Column, of: Column) -> Column:
    """How often ``of`` stands in ``text`` without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, of, F.lit("")))) / F.length(of)).cast("long")


def jsonish(raw: Column) -> Column:
    """JSON text out of a fenced answer, without control characters."""
    body = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    opened = F.regexp_replace(body, "^```[a-zA-Z]*\n?", "")
    bare = F.regexp_replace(F.regexp_replace(opened, r"(?U)^\s+|\s+$", ""), "\n?```$", "")
    return F.regexp_replace(F.when(body.startswith("```"), bare).otherwise(body), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def is_known_harmless(value: Column) -> Column:
    """Blank, already replaced, a UUID or 40 hexadecimal digits: never a secret."""
    v = trimmed(value)
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    return (v == "") | v.contains("[REDACTED_") | v.rlike(uuid) | v.rlike("^[0-9a-fA-F]{40}$")


def looks_random(value: Column) -> Column:
    """A long run with many characters, or of all three kinds."""
    slashes = F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))
    varied = F.size(F.array_distinct(F.split(F.regexp_replace(value, "=+$", ""), ""))) > 20
    kinds = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return ~is_known_harmless(value) & (F.length(value) >= 32) & (slashes < 2) & (varied | kinds)


def restricts(text: Column) -> Column:
    """Says that something is all there is."""
    from cartulary.functions.fixed import RESTRICTING, RESTRICTORS

    low = ascii_lower(text)
    return low.contains(RESTRICTING[0]) | low.contains(RESTRICTING[1]) | F.arrays_overlap(terms(text), strings(RESTRICTORS))
