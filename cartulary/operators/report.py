"""States, spending, budgets and coverage of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import token_estimate


def query_state(budget_hit: Column, chunks: Column, findings: Column, reasons: Column) -> Column:
    """State of a query from its counts and its drops' reasons."""
    provider = lambda r: r.startswith("provider_error")
    failed = (chunks > 0) & (findings == 0) & (F.size(reasons) > 0) & F.forall(reasons, provider)
    part = F.exists(reasons, lambda r: provider(r) | r.startswith("budget_hit"))
    return F.when(budget_hit, "budget_hit").when(failed, "provider_error").when(part, "partial").when(findings == 0, "unanswered").otherwise("ok")


def index_state(cards: Column, skipped: Column, unsupported: Column) -> Column:
    """State of an index from its cards and its skips' reasons."""
    failed = F.exists(skipped, lambda r: r.startswith("provider_error:"))
    over = F.array_contains(skipped, "budget_hit")
    return (
        F.when((cards == 0) & failed, "provider_error")
        .when((cards == 0) & over, "budget_hit")
        .when(over | failed, "partial")
        .when(F.array_contains(unsupported, "unsupported_or_tool_missing"), "tool_degraded")
        .otherwise("ok")
    )


def exit_code(state: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in fixed.STATES.items() for v in pair])
    return F.coalesce(F.try_element_at(codes, state), F.lit(1))


def weak_signal(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(weak): there are findings, and all score under 0.4 of the best candidate."""
    a = findings.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    b = candidates.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"))
    return a.join(F.broadcast(b)).select(((F.col("n") > 0) & (F.coalesce("best", F.lit(0.0)) < F.col("top") * fixed.WEAK_RATIO)).alias("weak"))


def usd(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * fixed.USD_IN + tokens_out / 1e6 * fixed.USD_OUT


def spend(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens, calls and dollars of (prompt_tokens, completion_tokens) rows."""
    sums = [F.sum("prompt_tokens").alias("in_tok"), F.sum("completion_tokens").alias("out_tok"), F.count(F.lit(1)).alias("calls")]
    return calls.groupBy(*keys).agg(*sums).withColumn("usd", F.round(usd(F.col("in_tok"), F.col("out_tok")), 6))


def chunk_cost(chunks: DataFrame) -> DataFrame:
    tokens = F.coalesce(F.sum(token_estimate(F.col("body")) + 700), F.lit(0))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.round(tokens / 1e6 * fixed.USD_IN + F.count(F.lit(1)) * 0.006, 6).alias("usd"))


def pack(items: Column, full: str, reduced: str, limit: int, base: int = fixed.PACK_BASE) -> Column:
    """For each of the ordered structs whether its quote is left out to keep the sum
    of costs within ``limit``; what is left out still costs its reduced form."""
    start = F.struct(F.lit(base).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, f: Column) -> Column:
        fits = s["used"] + f[full] <= limit
        return F.struct((s["used"] + F.when(fits, f[full]).otherwise(f[reduced])).alias("used"), F.concat(s["out"], F.array(~fits)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def coverage(skips: DataFrame) -> DataFrame:
    """Distinct (path, reason) that coverage leaves out, by adapter."""
    left = skips.where(F.col("reason").startswith("unsupported") | (F.col("reason") == "binary_or_unsupported"))
    return left.dropDuplicates(["path", "reason"]).groupBy(F.coalesce("adapter", F.lit("unknown")).alias("adapter")).agg(F.count(F.lit(1)).alias("n"))


def truncated(json: Column, budget: int) -> Column:
    """The JSON text, or a preview of four characters a token if it is over budget."""
    cut = F.to_json(F.struct(F.lit(True).alias("truncated"), F.left(json, F.lit(4 * budget)).alias("preview")))
    return F.when(token_estimate(json) > budget, cut).otherwise(json)
