"""Cards: an index row for each file; what can be reused and what has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import fixed, paths, skeleton
from cartulary.functions.redact import redact
from cartulary.functions.text import lines, terms, token_estimate

SCHEMA_VERSION = 1
#: Of the store's tables.
LAYOUT = 2
ADAPTER_VERSION, CARD_PROMPT = "1", "card-1"
#: Characters that an entry of the module map has at least, from its keys alone.
LEAST_ENTRY = 100
#: Fields that a model may have written.
MODEL_FIELDS = ("role", "invariants", "gotchas", "terms")
#: Columns of a generation's cards.
STORED = ("schema_version", "path", "hash", "adapter", "symbols", "imports", "outline", "churn", "loc", "harness_meta", "role", "invariants", "gotchas", "terms", "defined")


def hint(value: Column) -> Column:
    """Marks what a model may have written."""
    return F.struct(F.lit(True).alias("model_hint"), value.alias("value"))


def role_of(path: Column, text: Column) -> Column:
    """A file's role without a model."""
    return F.left(redact(F.trim(skeleton.role(path, text)))["text"], F.lit(fixed.ROLE_CHARS))


def skeletons(files: DataFrame, churn: DataFrame | None = None, *more: Column) -> DataFrame:
    """Cards without model fields for (path, text, adapter, hash), and the columns ``more`` beside."""
    path, text, kind = F.col("path"), F.col("text"), F.col("adapter")
    joined = files.join(churn, "path", "left") if churn is not None else files.withColumn("churn", F.lit(0))
    nothing = F.array().cast("array<string>")
    role = role_of(path, text)
    return joined.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "path", "hash", "adapter",
        skeleton.symbols(text, kind).alias("symbols"), skeleton.imports(text).alias("imports"), skeleton.outline(text).alias("outline"),
        F.coalesce("churn", F.lit(0)).cast("int").alias("churn"), F.size(lines(text)).alias("loc"), paths.about_project(path).alias("harness_meta"),
        hint(role).alias("role"), hint(nothing).alias("invariants"), hint(nothing).alias("gotchas"), hint(skeleton.defined_terms(text)).alias("terms"),
        *more,
    )


def drafts(walked: DataFrame, head: bool = False) -> DataFrame:
    """All that an index needs of each walked file's text, in one pass: cards without churn
    and model fields, and skip_reason, size, mtime_ms, ``blank`` (a converter gave nothing),
    ``tokens`` of a card's prompt, ``text_terms`` and, with ``head``, that prompt's text.

    Written once it stands for the files: nothing derived from it opens or redacts a
    file again, or deals out a text.  Rows that are left out have an empty text.
    """
    rows = walked.withColumns({c: F.lit(None).cast("long") for c in ("size", "mtime_ms") if c not in walked.columns})
    rows = rows.withColumn("text", F.coalesce(F.when(F.col("skip_reason").isNull(), F.col("text")), F.lit("")))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    begun = F.left("text", F.lit(fixed.CARD_CHARS))
    blank = F.col("adapter").isin("pdf", "docx") & (F.trim("text") == "")
    more = [blank.alias("blank"), token_estimate(begun).alias("tokens"), terms(F.left("text", F.lit(fixed.SCORED_CHARS))).alias("text_terms")]
    return skeletons(rows, None, F.col("skip_reason"), F.col("size"), F.col("mtime_ms"), *more, *([begun.alias("text")] if head else []))


def changed_often(fresh: DataFrame, churn: DataFrame | None) -> DataFrame:
    """``fresh`` cards with their count of changes, 0 if there is none."""
    if churn is None:
        return fresh
    counts = churn.select("path", F.col("churn").alias("_churn"))
    return fresh.join(counts, "path", "left").withColumn("churn", F.coalesce("_churn", F.lit(0)).cast("int")).drop("_churn")


def model_fields(old: DataFrame) -> DataFrame:
    """(path, hash, m_role, ...): the values of a generation's model fields."""
    return old.select("path", "hash", *[F.col(f"{c}.value").alias(f"m_{c}") for c in MODEL_FIELDS])


def carded(fresh: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Cards as a generation keeps them: ``fresh`` ones with the model fields that are
    ``known`` of the same path and hash; ``defined`` are the terms without a model."""
    fresh = fresh.withColumn("defined", F.col("terms.value"))
    if known is None:
        return fresh
    value = lambda c: hint(F.coalesce(F.col(f"m_{c}"), F.col(f"{c}.value")))
    joined = fresh.join(known, ["path", "hash"], "left")
    return joined.withColumns({c: value(c) for c in MODEL_FIELDS}).drop(*[f"m_{c}" for c in MODEL_FIELDS])


def manifest(model: str = "none", ignore: tuple[str, ...] = (), markdown_only: bool = False, rules: str = "") -> dict:
    """What a generation was made with; another one's cards aren't reused.

    ``ignore`` are rules handed in, ``rules`` signs those of the corpus's own ignore files.
    """
    rules = hashlib.sha256("\n".join((*ignore, rules)).encode()).hexdigest()
    return {"layout": LAYOUT, "schema_version": SCHEMA_VERSION, "card_prompt": CARD_PROMPT, "adapter_version": ADAPTER_VERSION, "model": model, "ignore_hash": rules, "markdown_only": markdown_only}


def reuse(files: DataFrame, old: DataFrame, field: str = "role") -> DataFrame:
    """``files`` with ``reused`` and the old card's ``field`` where path and hash are as before."""
    known = old.select("path", "hash", F.col(field).alias("_old"), F.lit(True).alias("_known"))
    out = files.join(known, ["path", "hash"], "left")
    value = F.coalesce(F.col("_old"), F.col(field)) if field in files.columns else F.col("_old")
    return out.withColumn("reused", F.coalesce("_known", F.lit(False))).withColumn(field, value).drop("_old", "_known")


def to_card(files: DataFrame, old: DataFrame) -> DataFrame:
    """Files whose card has to be made: new or changed, and not empty after conversion."""
    empty = F.col("adapter").isin("pdf", "docx") & (F.trim("text") == "")
    return files.where(~empty).join(old.select("path", "hash"), ["path", "hash"], "left_anti")


def differences(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change) over two snapshots of (path, hash), whose texts had to be read."""
    a, b = now.alias("a"), then.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same = F.col("a.hash").eqNullSafe(F.col("b.hash"))
    kind = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), kind.alias("change"))


def at_first_sight(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, adapter, size, mtime_ms, change) by names, sizes and times alone.

    ``now`` is (path, adapter, size, mtime_ms), ``then`` has (path, size, mtime_ms).  Equal size and time mean
    unchanged; a text of another size is changed; the rest is ``undecided`` and has to be read.
    """
    a, b = now.alias("a"), then.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    sized = F.col("a.size") == F.col("b.size")
    kind = (
        F.when(F.col("b.path").isNull(), "added")
        .when(F.col("a.path").isNull(), "removed")
        .when(sized & (F.col("a.mtime_ms") == F.col("b.mtime_ms")), "unchanged")
        .when(~sized & ~F.col("a.adapter").isin("pdf", "docx"), "changed")
        .otherwise("undecided")
    )
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), "a.adapter", "a.size", "a.mtime_ms", kind.alias("change"))


def decided(first: DataFrame, read: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change): ``first`` with its undecided paths decided by what was ``read`` of them,
    (path, text, skip_reason), against (path, hash, skip_reason) of ``then``."""
    seen = read.select("path", F.when(F.col("skip_reason").isNull(), F.sha2("text", 256)).alias("hash"), "skip_reason")
    old = then.select("path", F.col("hash").alias("_hash"), F.col("skip_reason").alias("_reason"))
    same = F.col("hash").eqNullSafe(F.col("_hash")) & F.col("skip_reason").eqNullSafe(F.col("_reason"))
    found = seen.join(old, "path").select("path", F.when(same, "unchanged").otherwise("changed").alias("_change"))
    # one that is gone by now has no row
    kind = F.when(F.col("change") == "undecided", F.coalesce("_change", F.lit("removed"))).otherwise(F.col("change"))
    return first.select("path", "change").join(found, "path", "left").select("path", kind.alias("change"))


def index_cost(files: DataFrame) -> DataFrame:
    """(n, usd): estimate of making cards for ``files``, which have ``text`` or ``tokens``."""
    each = F.col("tokens") if "tokens" in files.columns else token_estimate(F.left("text", F.lit(fixed.CARD_CHARS)))
    return files.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(each + 700), F.lit(0)) / 1e6 * fixed.USD_IN + F.count(F.lit(1)) * 0.001, 6).alias("usd"))


def module_map(cards: DataFrame) -> DataFrame:
    """(dir, files): cards by directory, in order of path, with their first symbols."""
    return cards.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_list(map_entry())).alias("files"))


def map_entry() -> Column:
    return F.struct("path", "role", F.slice("symbols", 1, 8).alias("symbols"), F.slice("outline", 1, 8).alias("outline"), "loc", "churn", "harness_meta")


def map_within(cards: DataFrame, chars: int) -> DataFrame:
    """(dir, entry): the module map's beginning, in order of directory and path, up to the
    entry that reaches ``chars`` characters of JSON.

    An entry has LEAST_ENTRY characters at least, so no task hands on, and no one task sums
    up, more than ``chars`` / LEAST_ENTRY entries, whatever the number of cards.
    """
    rows = cards.select(paths.parent(F.col("path")).alias("dir"), map_entry().alias("entry"))
    rows = rows.withColumn("chars", F.length(F.to_json("entry"))).orderBy("dir", "entry.path").limit(chars // LEAST_ENTRY + 1)
    before = Window.orderBy("dir", "entry.path").rowsBetween(Window.unboundedPreceding, -1)  # the rows of the limit
    return rows.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("before") < chars).select("dir", "entry")


def entry_points(cards: DataFrame, most: int = 20) -> DataFrame:
    """Where to begin: files with many imports and changes first, files about the project last."""
    score = F.size("imports") + F.col("churn")
    return cards.withColumn("score", score).orderBy("harness_meta", F.desc("score"), "path").limit(most)


def scored_text(path: Column, role: Column, symbols: Column, text: Column) -> Column:
    """What candidates are scored by: path, role, symbol names and the text's beginning."""
    return F.concat_ws(" ", path, role, F.array_join(F.transform(symbols, lambda s: s["name"]), " "), F.left(text, F.lit(fixed.SCORED_CHARS)))


def own_term_sets(files: DataFrame) -> DataFrame:
    """(path, terms) of files as they are, in one pass without cards."""
    path, text = F.col("path"), F.col("text")
    return files.select("path", terms(scored_text(path, role_of(path, text), skeleton.symbols(text, F.col("adapter")), text)).alias("terms"))


def term_sets(cards: DataFrame) -> DataFrame:
    """(path, terms) of drafted cards: what the text gave, after path, role and symbols."""
    names = F.array_join(F.transform("symbols", lambda s: s["name"]), " ")
    own = terms(F.concat_ws(" ", F.col("path"), F.col("role.value"), names))
    return cards.select("path", F.array_distinct(F.concat(own, "text_terms")).alias("terms"))
