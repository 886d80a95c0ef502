"""The extractor seam: chunks in, raw findings out.

A provider is any object with ``answer(system, user, max_tokens)``.  It is made by
a factory on the executors, one for each partition, with its part of the rate.
Without one the offline lexical extractor below finds lines by their words; it
is not a model and never stands in for one.
"""

from __future__ import annotations

import functools
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.redact import redact
from cartulary.functions.text import jsonish, strings, terms
from cartulary.plans.ledger import Ledger

RAW = "array<struct<fact:string,line:int,quote:string>>"
#: Partitions that call a provider at once; each has its part of the rate.
PARALLEL = 50
ATTEMPTS, BACKOFF_S = 6, 60.0
EXTRACTOR = (
    "You read one numbered chunk of one file and a question. Answer with a JSON array only; each element has "
    "fact (one sentence), line (number) and quote (copied verbatim, without the number). Leave out whatever the chunk "
    "does not say; an empty array is a good answer."
)


class Answer(NamedTuple):
    text: str
    in_tok: int
    out_tok: int
    retries: int = 0


class Provider(Protocol):
    def answer(self, system: str, user: str, max_tokens: int) -> Answer: ...


class ProviderError(RuntimeError):
    """The provider gave no answer."""


class Bucket:
    """At most ``per_minute`` calls, with bursts up to a minute's worth."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.clock = per_minute / 60.0, clock
        self.size = self.tokens = max(1.0, per_minute)
        self.at = clock()

    def wait_s(self) -> float:
        """Takes a token, or says how long to wait for one."""
        now = self.clock()
        self.tokens, self.at = min(self.size, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= 1:
            self.tokens -= 1
            return 0.0
        return (1 - self.tokens) / self.rate


def backoff_s(attempt: int, draw: Callable[[float, float], float] = random.uniform) -> float:
    return draw(0.0, min(2.0**attempt, BACKOFF_S))


class HttpProvider:
    """A chat endpoint named by CARTULARY_URL, CARTULARY_MODEL and CARTULARY_KEY.

    Once this provider has spent ``most_usd`` it asks nothing a second time.
    """

    def __init__(self, per_minute: float = fixed.CALLS_PER_MINUTE / PARALLEL, *, most_usd: float | None = None):
        missing = [v for v in ("CARTULARY_URL", "CARTULARY_MODEL", "CARTULARY_KEY") if not os.environ.get(v)]
        if missing:
            raise ProviderError(f"set {', '.join(missing)}")
        self.bucket, self.most_usd, self.usd = Bucket(per_minute), most_usd, 0.0

    def check_retry(self) -> None:
        if self.most_usd is not None and self.usd >= self.most_usd:
            raise ProviderError("budget cap hit before provider retry")

    def answer(self, system: str, user: str, max_tokens: int) -> Answer:
        body = {"model": os.environ["CARTULARY_MODEL"], "temperature": 0, "stream": False, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ['CARTULARY_KEY']}"}
        request = urllib.request.Request(os.environ["CARTULARY_URL"], json.dumps(body).encode(), headers)
        for attempt in range(ATTEMPTS):
            if attempt:
                self.check_retry()
            while wait := self.bucket.wait_s():
                time.sleep(wait)
            try:
                with urllib.request.urlopen(request, timeout=120) as got:
                    found = json.load(got)
                used = found.get("usage", {})
                self.usd += used.get("prompt_tokens", 0) / 1e6 * fixed.USD_IN + used.get("completion_tokens", 0) / 1e6 * fixed.USD_OUT
                return Answer(found["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0), attempt)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or attempt == ATTEMPTS - 1:
                    raise ProviderError(f"status {e.code}") from e
            except OSError as e:
                if attempt == ATTEMPTS - 1:
                    raise ProviderError(str(e)[:200]) from e
            time.sleep(backoff_s(attempt))
        raise ProviderError("no answer")


class Desk:
    """A task's way to its provider: the ledger first, then a call, which is written down.

    The provider is made when it is first needed.  ``left_usd`` is this task's share of what may still be
    spent; beyond it the provider asks nothing a second time.
    """

    def __init__(self, factory: Callable[[], Provider], ledger: Ledger | None, left_usd: float | None):
        self.factory, self.ledger, self.left_usd, self.provider = factory, ledger, left_usd, None

    def ask(self, system: str, user: str, max_tokens: int, *about: object) -> tuple[str | None, int, int, int, str | None]:
        """(answer, tokens in, tokens out, retries, error); errors are not written down."""
        key = Ledger.key(os.environ.get("CARTULARY_MODEL", ""), system, user, max_tokens, *about)
        known = self.ledger.get(key) if self.ledger else None
        if known is None:
            try:
                if self.provider is None:
                    self.provider = self.factory()
                    if self.left_usd is not None and hasattr(self.provider, "most_usd"):
                        self.provider.most_usd = self.left_usd
                got = self.provider.answer(system, user, max_tokens)
            except ProviderError as e:
                return None, 0, 0, 0, f"provider_error: {str(e).replace(chr(10), ' ')[:200]}"
            known = got._asdict()
            if self.ledger:
                self.ledger.put(key, known)
        return known["text"], known["in_tok"], known["out_tok"], known["retries"], None


def asked(factory: Callable[[], Provider], query: str, max_tokens: int, ledger: Ledger | None = None, left_usd: float | None = None):
    """mapInPandas function: each redacted chunk sent, and answered or failed."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk = Desk(factory, ledger, left_usd)
        for batch in batches:
            out = []
            for path, first, text, count, look in zip(batch["path"], batch["first_line"], batch["text"], batch["count"], batch["look_for"]):
                user = f"FILE: {path} (from line {first})\nLOOK FOR: {look or ''}\nREDACTIONS: {count}\n\n{text}\n\nQUERY: {query}"
                out.append((path, first, *desk.ask(EXTRACTOR, user, max_tokens, path, int(first))))
            yield pd.DataFrame(out, columns=["path", "first_line", "raw", "in_tok", "out_tok", "retries", "error"])

    return run


def ask(chunks: DataFrame, factory: Callable[[], Provider], query: str, parallel: int = PARALLEL, max_tokens: int = 2000, ledger: Ledger | None = None, left_usd: float | None = None) -> DataFrame:
    """(path, first_line, raw, in_tok, out_tok, retries, error) for each chunk."""
    sent = chunks.select("path", "first_line", redact(F.col("body")).alias("r"), "look_for").select("path", "first_line", "r.*", "look_for").repartition(parallel, "path", "first_line")
    share = None if left_usd is None else left_usd / parallel
    return sent.mapInPandas(asked(factory, query, max_tokens, ledger, share), "path string, first_line int, raw string, in_tok long, out_tok long, retries long, error string")


def spent(answers: DataFrame) -> dict:
    """Tokens, retries, calls and dollars of answers."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_tok", "out_tok", "retries")]
    out = answers.agg(*sums, F.count(F.lit(1)).alias("calls")).first().asDict()
    return out | {"usd": out["in_tok"] / 1e6 * fixed.USD_IN + out["out_tok"] / 1e6 * fixed.USD_OUT}


def in_waves(rows: DataFrame, wave: Column, cost: Column, cap: float | None, send: Callable[[DataFrame, float | None], DataFrame], write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame, dict]:
    """(answers, refused rows, what was spent): rows are sent wave by wave, each written
    before the next, so that one cap holds for all tasks together.

    Before a wave its estimated ``cost`` is added to what was really spent so far; a wave that
    would pass the cap is refused and so is every later one.  More than a cap's worth can
    thus be spent by what one wave costs beyond its estimate only.  ``rows`` should be a written table.
    """
    plan = rows.groupBy(wave.alias("wave")).agg(F.sum(cost).alias("usd")).orderBy("wave").collect() if cap is not None else None
    if plan is None:
        answers = write(send(rows, None))
        return answers, rows.limit(0), spent(answers)
    parts, total, gone = [], {"in_tok": 0, "out_tok": 0, "retries": 0, "calls": 0, "usd": 0.0}, []
    for r in plan:
        if gone or total["usd"] + r["usd"] > cap:
            gone.append(r["wave"])
            continue
        parts.append(write(send(rows.where(wave == r["wave"]), cap - total["usd"])))
        total = {k: v + total[k] for k, v in spent(parts[-1]).items()}
    refused = rows.where(wave >= gone[0]) if gone else rows.limit(0)
    return (functools.reduce(DataFrame.unionByName, parts) if parts else None), refused, total


CARD_WRITER = (
    "You describe one file for an index. Answer with a JSON object only: role (one sentence), invariants (strings), "
    "gotchas (strings), terms (strings). Say only what the text shows."
)
ROUTER = (
    "You get a question and numbered files with their roles. Answer with a JSON object only: files, a list of objects "
    "with path, look_for (what to look for there) and rank (1 is best). Name only paths from the list."
)
CARD = "struct<role:string,invariants:array<string>,gotchas:array<string>,terms:array<string>>"
ROUTED = "struct<files:array<struct<path:string,look_for:string,rank:int>>>"
HINTS, TERMS = 8, 12


def written(factory: Callable[[], Provider], max_tokens: int, ledger: Ledger | None = None, left_usd: float | None = None):
    """mapInPandas function: each file's card as the provider writes it from a redacted text, or its error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk = Desk(factory, ledger, left_usd)
        for batch in batches:
            out = []
            for path, hash_, text in zip(batch["path"], batch["hash"], batch["text"]):
                out.append((path, hash_, *desk.ask(CARD_WRITER, f"FILE: {path}\n\n{text}", max_tokens, path, hash_)))
            yield pd.DataFrame(out, columns=["path", "hash", "raw", "in_tok", "out_tok", "retries", "error"])

    return run


def write_cards(files: DataFrame, factory: Callable[[], Provider], parallel: int = PARALLEL, max_tokens: int = 900, ledger: Ledger | None = None, left_usd: float | None = None) -> DataFrame:
    """(path, hash, role, invariants, gotchas, terms, in_tok, out_tok, retries, error).

    One call for each file, on its redacted beginning.  What can't be parsed has
    null fields, so that the deterministic ones stay.
    """
    begun = files.select("path", "hash", redact(F.left("text", F.lit(fixed.CARD_CHARS)))["text"].alias("text")).repartition(parallel, "path")
    share = None if left_usd is None else left_usd / parallel
    got = begun.mapInPandas(written(factory, max_tokens, ledger, share), "path string, hash string, raw string, in_tok long, out_tok long, retries long, error string")
    card = F.from_json(jsonish(F.col("raw")), CARD)
    role = F.when(F.trim(card["role"]) != "", F.left(F.trim(card["role"]), F.lit(fixed.ROLE_CHARS)))
    return got.select("path", "hash", role.alias("role"), F.slice(card["invariants"], 1, HINTS).alias("invariants"), F.slice(card["gotchas"], 1, HINTS).alias("gotchas"), F.slice(card["terms"], 1, TERMS).alias("terms"), "in_tok", "out_tok", "retries", "error")


def routed(factory: Callable[[], Provider], query: str, max_tokens: int):
    """mapInPandas function: a page of (path, role) is one call; no answer, no rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        for batch in batches:
            out = []
            for listed in batch["listed"]:
                try:
                    provider = provider or factory()
                    out.append(provider.answer(ROUTER, f"QUESTION: {query}\n\n{listed}", max_tokens).text)
                except ProviderError:
                    continue
            yield pd.DataFrame({"raw": out}, dtype=object)

    return run


def route(cards: DataFrame, factory: Callable[[], Provider], query: str, page: int = 500, max_tokens: int = 4000) -> DataFrame:
    """(path, router_rank, look_for) that the provider names for a query.

    It sees paths and roles only, ``page`` at a time, so that no task or call grows
    with the corpus; paths that no card has are discarded.  A page without a
    usable answer adds nothing.
    """
    thin = cards.select("path", F.col("role.value").alias("role"))
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page)).alias("pages")
    dealt = thin.join(F.broadcast(thin.agg(pages))).withColumn("page", F.pmod(F.xxhash64("path"), F.col("pages")))
    listed = dealt.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "role"))), "\n").alias("listed"))
    raw = listed.select("listed").mapInPandas(routed(factory, query, max_tokens), "raw string")
    found = raw.select(F.explode_outer(F.from_json(jsonish(F.col("raw")), ROUTED)["files"]).alias("f")).where("f.path is not null")
    named = found.select("f.path", F.coalesce("f.rank", F.lit(0)).alias("router_rank"), F.coalesce("f.look_for", F.lit("")).alias("look_for"))
    return named.join(cards.select("path"), "path", "left_semi")


def parsed(raw: Column) -> Column:
    """Findings of an answer; null if it is no JSON array."""
    return F.from_json(jsonish(raw), RAW)


def findings_of(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, line, fact, quote, router_rank, score): rows without fact or line don't count."""
    each = answers.where("error is null").select("path", "first_line", F.explode_outer(parsed(F.col("raw"))).alias("f"))
    found = each.where("f.fact is not null and f.line is not null").select("path", "first_line", "f.line", "f.fact", "f.quote")
    return found.join(chunks.select("path", "first_line", "router_rank", "score"), ["path", "first_line"]).drop("first_line")


def failures_of(answers: DataFrame) -> DataFrame:
    """(path, line, fact, quote, reason) of chunks without a usable answer."""
    bad = answers.withColumn("reason", F.coalesce("error", F.when(parsed(F.col("raw")).isNull(), "unparseable: not a JSON array")))
    none = F.lit(None).cast("string")
    return bad.where("reason is not null").select("path", F.col("first_line").alias("line"), none.alias("fact"), F.left("raw", F.lit(500)).alias("quote"), "reason")


def lexical_findings(chunks: DataFrame, query_terms: list[str], least: int = 2, most: int = 3) -> DataFrame:
    """The offline extractor: in each chunk the ``most`` lines that share most terms
    with the query, ``least`` at least; fact and quote are the line."""
    rows = F.split("body", "\n", -1)
    line = lambda s: F.struct(F.size(F.array_intersect(terms(F.regexp_replace(s, r"^\d+\| ", "")), strings(query_terms))).alias("hits"), (-F.regexp_extract(s, r"^(\d+)\| ", 1).cast("int")).alias("at"), F.trim(F.regexp_replace(s, r"^\d+\| ", "")).alias("text"))
    need = min(least, len(query_terms)) if query_terms else 1
    best = F.slice(F.sort_array(F.filter(F.transform(rows, line), lambda x: x["hits"] >= need), asc=False), 1, most)
    found = chunks.select("path", "router_rank", "score", F.explode_outer(best).alias("f")).where("f is not null")
    return found.select("path", (-F.col("f.at")).alias("line"), F.col("f.text").alias("fact"), F.col("f.text").alias("quote"), "router_rank", "score")
