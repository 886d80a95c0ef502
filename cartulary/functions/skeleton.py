"""What a text is made of: symbols, imports, headings, terms, role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions import fixed, paths
from cartulary.functions.text import lines

# Fixed values. Line patterns of the public contract.
SYMBOL = r"(?U)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|class|struct|enum|trait|impl|function|const)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"(?U)^\s*(?:use\s+[^;]+;|mod\s+\w+;|import\s+.+|from\s+\S+\s+import\s+.+|#include\s+.+)"
HEADING = r"(?Us)^\s*(#{1,6}) (.*)$"
DEFINED = r"(?m)^\s*(?:\*\*)?([A-Z][A-Za-z0-9 _/-]{2,40})(?:\*\*)?\s*[:—-]"
MOST, MOST_TERMS, IMPORT_CHARS, HEADING_CHARS = 200, 50, 240, 120


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def most_of(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def outline(text: Column, most: int | None = MOST) -> Column:
    """Headings: array of (text, line, level); a card keeps MOST, None gives all."""
    each = F.transform(lines(text), lambda s, i: F.struct(strip(F.regexp_extract(s, HEADING, 2)).alias("text"), (i + 1).alias("line"), F.length(F.regexp_extract(s, HEADING, 1)).alias("level")))
    return most_of(F.filter(each, lambda h: h["level"] > 0), most)


def code_symbols(text: Column, most: int | None = MOST) -> Column:
    each = F.transform(lines(text), lambda s, i: F.struct(F.regexp_extract(s, SYMBOL, 1).alias("name"), F.regexp_extract(s, r"(?U)^\s*(\S+)", 1).alias("kind"), (i + 1).alias("line")))
    return most_of(F.filter(each, lambda s: s["name"] != ""), most)


def symbols(text: Column, adapter: Column) -> Column:
    """Array of (name, kind, line): headings of prose, definitions of code."""
    heads = F.transform(outline(text), lambda h: F.struct(h["text"].alias("name"), F.lit("heading").alias("kind"), h["line"].alias("line")))
    return F.when(paths.is_prose(adapter), heads).otherwise(code_symbols(text))


def imports(text: Column) -> Column:
    found = F.filter(lines(text), lambda s: s.rlike(IMPORT))
    return F.slice(F.transform(found, lambda s: F.left(strip(s), F.lit(IMPORT_CHARS))), 1, MOST)


def defined_terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(DEFINED), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, strip)), 1, MOST_TERMS)


def role(path: Column, text: Column) -> Column:
    """A sentence on a file from its name, first heading or first symbol."""
    kind, heads = paths.adapter(path), outline(text)
    first = F.get(symbols(text, kind), F.lit(0))
    named = F.concat(F.lit("defines "), first["name"], F.lit(" and related "), first["kind"], F.lit(" code"))
    agent = F.lit(False)
    for name in fixed.AGENT_FILES:
        agent |= path.endswith(name)
    return (
        F.when(agent, "agent working agreements and repo instructions")
        .when(path.endswith("README.md"), "project overview and usage documentation")
        .when(F.size(heads) > 0, F.left(heads[0]["text"], F.lit(HEADING_CHARS)))
        .when(first.isNotNull(), named)
        .otherwise(F.concat(kind, F.lit(" file")))
    )
