"""The commands: index, query, brief, refresh and evaluate, over any corpus.

Each is one lazy DataFrame plan up to its result; the driver holds envelopes and
a query's bounded findings only.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import fixed
from cartulary.functions.text import token_estimate
from cartulary.operators import cards as cards_
from cartulary.operators import chunk, evalkit, firewall, postings, report, route
from cartulary.plans import provider as seam
from cartulary.plans.ledger import Ledger
from cartulary.plans.store import Generations
from cartulary.sources import corpus
from cartulary.sources.staged import Staged
from cartulary.sources.tree import Directory

#: Chunks that are asked at once under a cap; files of an index's wave, and most waves.
WAVE_CHUNKS, WAVE_FILES, MOST_WAVES = 8, 500, 200
#: What the answers of an index's calls are kept under; a question's, under its text.
CARDS = "cards\n"


@dataclass
class Envelope:
    """What a command answers: state, data, spending and what was left out."""

    command: str
    state: str = "ok"
    data: dict = field(default_factory=dict)
    spend: dict = field(default_factory=dict)
    skipped: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    schema: str = "cartulary.response.v1"

    @property
    def exit_code(self) -> int:
        return fixed.STATES.get(self.state, 1)


def answer(spark: SparkSession, files: DataFrame, query: str, mode: str = "fixed", window: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP, cap: int = fixed.CHUNK_CAP, term_sets: DataFrame | None = None) -> DataFrame:
    """The flagship plan, offline: candidates by rare terms, capped chunks, lexical
    findings, the firewall and the final order; (ord, file, line, fact, quote,
    match_tier, score)."""
    if term_sets is None:
        term_sets = cards_.own_term_sets(files)
    picked = route.candidates(spark, term_sets, query)
    picked = spark.createDataFrame(picked.collect(), picked.schema)  # at most CANDIDATES rows, found once
    chosen = files.join(F.broadcast(picked), "path")
    cut = chunk.chunks(chosen.withColumns({"router_rank": F.lit(None).cast("int"), "look_for": F.lit(None).cast("string")}), mode, window, overlap)
    ranked = chunk.rank_chunks(cut, query, cap)
    found = seam.lexical_findings(ranked, route.query_terms(spark, query))
    held = firewall.passed(firewall.verify(found, chosen.select(*files.columns)))
    held = firewall.distinct(held.where(firewall.holds_claim(F.lit(query), F.col("quote"))))
    return held.orderBy(*firewall.in_order(held)).select(F.col("path").alias("file"), "line", "fact", "quote", "match_tier", "score")


class Engine:
    """Commands over a corpus and a store.

    ``files`` makes the corpus anew when called: a DataFrame of (path, text,
    adapter, skip_reason) as ``corpus.walk`` gives it.  A ``tree.Directory`` is one too, and tells
    sizes and times without opening a file, so that only what is asked for is read.
    """

    def __init__(self, spark: SparkSession, files: Callable[[], DataFrame], store: str, churn: DataFrame | None = None, markdown_only: bool = False, model: str = "none", ignore: tuple[str, ...] = ()):
        self.spark, self.files, self.churn, self.markdown_only = spark, files, churn, markdown_only
        self.model, self.ignore = model, ignore
        self.store = Generations(spark, store)
        self.tree = files if isinstance(files, Directory) else None

    @contextlib.contextmanager
    def work(self) -> Iterator[Staged]:
        """Tables of one command, deleted when it ends; the directory is listed anew for it."""
        if self.tree:
            self.tree.forget()
        staged = Staged(self.spark, f"{self.store.top}/work-{uuid.uuid4().hex}")
        try:
            yield staged
        finally:
            staged.close()
            if self.tree:
                self.tree.forget()

    @staticmethod
    def answers_at(about: str) -> str:
        return f"answers/{hashlib.sha256(about.encode()).hexdigest()[:16]}"

    def ledger(self, about: str) -> Ledger:
        return Ledger(self.store.fs.makeQualified(self.store.path(self.answers_at(about))).toString())

    def manifest(self) -> dict:
        return cards_.manifest(self.model, self.ignore, self.markdown_only, self.tree.rules_sign() if self.tree else "")

    def current(self) -> tuple[str, dict] | None:
        """The generation, if it was made as this engine would make it."""
        opened, mine = self.store.open(), self.manifest()
        return opened if opened and {k: opened[1].get(k) for k in mine} == mine else None

    def old_cards(self) -> DataFrame | None:
        opened = self.current()
        return self.store.table(opened[0], "cards") if opened else None

    def estimate(self) -> dict:
        """(n, usd) of the files whose cards have to be made."""
        with self.work() as staged:
            drafts = staged.write(cards_.drafts(self.files()))
            return cards_.index_cost(self.to_card(drafts, self.old_cards())).first().asDict()

    @staticmethod
    def to_card(drafts: DataFrame, old: DataFrame | None) -> DataFrame:
        work = drafts.where("skip_reason is null and not blank")
        return work.join(old.select("path", "hash"), ["path", "hash"], "left_anti") if old is not None else work

    def index(self, max_usd: float | None = None, factory: Callable[[], seam.Provider] | None = None, confirm: Callable[[dict], bool] | None = None) -> Envelope:
        """A new generation; cards of unchanged files keep their model fields.

        Each file is read once, into drafts that all tables come from.  ``confirm`` sees the estimate before
        anything is spent and may decline.  With a provider's ``factory`` the others' model
        fields are written by it, in waves under one cap; a file that it fails on, or that the cap leaves no
        room for, is skipped with the reason and made next time.  Answers of a build that
        fails are found again by the next one.
        """
        with self.work() as staged:
            return self._index(staged, max_usd, factory, confirm)

    def _index(self, staged: Staged, max_usd: float | None, factory: Callable[[], seam.Provider] | None, confirm: Callable[[dict], bool] | None) -> Envelope:
        drafts, old = staged.write(cards_.drafts(self.files(), head=bool(factory))), self.old_cards()
        work = self.to_card(drafts, old)
        cost = cards_.index_cost(work).first().asDict()
        out = Envelope("index", data={"files_to_card": cost["n"], "estimated_usd": cost["usd"]})
        if max_usd is not None and cost["usd"] > max_usd:
            out.state = "budget_hit"
            return out
        if confirm and cost["usd"] > 0 and not confirm(cost):
            out.state, out.data["cancelled"] = "budget_hit", True
            return out
        fresh, skipped = drafts.where("skip_reason is null"), corpus.rejected(drafts)
        model = [cards_.model_fields(old)] if old is not None else []
        if factory:
            work = staged.write(work.select("path", "hash", "text", "tokens"))
            waves = min(MOST_WAVES, max(1, -(-cost["n"] // WAVE_FILES)))
            send = lambda rows, left: seam.write_cards(rows, factory, ledger=self.ledger(CARDS), left_usd=left)
            usd = (F.col("tokens") + 700) / 1e6 * fixed.USD_IN + 0.001
            made, refused, out.spend = seam.in_waves(work, F.pmod(F.xxhash64("path"), F.lit(waves)), usd, max_usd, send, staged.write)
            failed = refused.select("path", F.lit("budget_hit").alias("reason"), F.lit(None).cast("string").alias("adapter"))
            if made is not None:
                failed = failed.unionByName(made.where("error is not null").select("path", F.col("error").alias("reason"), F.lit(None).cast("string").alias("adapter")))
                model.append(made.where("error is null").select("path", "hash", *[F.col(c).alias(f"m_{c}") for c in cards_.MODEL_FIELDS]))
            skipped = skipped.unionByName(failed)
            fresh = fresh.join(failed.select("path"), "path", "left_anti")
        known = functools.reduce(DataFrame.unionByName, model) if model else None
        made_cards = cards_.carded(cards_.changed_often(fresh, self.churn), known)
        tables = index_tables(made_cards, drafts, skipped)
        out.data["generation"] = self.store.publish(tables, self.manifest() | {"generated_at_ms": int(time.time() * 1000)}, derived=posted)
        self.store.delete(self.answers_at(CARDS))
        reasons = self.store.table(out.data["generation"], "skipped").agg(F.collect_set("reason").alias("r"))
        n = self.store.table(out.data["generation"], "cards").count()
        out.state = reasons.select(report.index_state(F.lit(n), F.col("r"), F.col("r"))).first()[0]
        out.data["cards"] = n
        return out

    def changes(self, staged: Staged) -> DataFrame | None:
        """(path, change) of the corpus against the current generation, files that
        it left out not counted.

        In a directory names, sizes and times decide first, and only what they leave open is
        opened; a table's texts are hashed.
        """
        opened = self.store.open()
        if not opened:
            return None
        then = self.store.table(opened[0], "meta")
        if not self.tree:
            now = corpus.accepted(self.files())
            return cards_.differences(now, then.where("skip_reason is null")).where("change <> 'unchanged'")
        first = staged.write(cards_.at_first_sight(self.tree.meta(), then))
        open_ = first.where("change = 'undecided'")
        if open_.isEmpty():
            return first.select("path", "change").where("change <> 'unchanged'")
        return cards_.decided(first, self.tree.read(open_), then).where("change <> 'unchanged'")

    def staleness(self) -> dict:
        with self.work() as staged:
            return self._staleness(staged)

    def _staleness(self, staged: Staged) -> dict:
        if not self.current():
            return {"stale": True, "reason": "manifest_mismatch", "changed_files": 0}
        n = self.changes(staged).count()
        return {"stale": n > 0, "reason": "content_hash_mismatch" if n else "current", "changed_files": n}

    def refresh(self, max_usd: float | None = None, factory: Callable[[], seam.Provider] | None = None) -> Envelope:
        """Builds anew what is stale, unless the estimate is over ``max_usd`` or over
        what may be spent without a word."""
        if not self.staleness()["stale"]:
            return Envelope("index", data={"refreshed": False})
        cost = self.estimate()
        for most, hint in ((max_usd, "index with a higher cap"), (fixed.REFRESH_USD, "the estimate is over what a refresh spends without asking; index first")):
            if most is not None and cost["usd"] > most:
                return Envelope("index", "budget_hit", {"hint": hint, "estimated_usd": cost["usd"], "max_usd": most, "changed_files": cost["n"]})
        return self.index(max_usd, factory)

    def candidates(self, generation: str, text: str) -> DataFrame:
        """Files for a question, from the postings of its own terms."""
        table = lambda name: self.store.table(generation, name)
        counted = table("counts") if len(self.store.layers(generation)) == 1 else None
        return postings.candidates(self.spark, table("postings"), table("cards").select("path"), text, counted)

    def query(self, text: str, factory: Callable[[], seam.Provider] | None = None, router: DataFrame | None = None, routing: bool = False, mode: str = "boundary_overlap", window: int = fixed.CHUNK_LINES, cap: int = fixed.CHUNK_CAP, max_usd: float | None = None, budget_tokens: int | None = None, wave: int = WAVE_CHUNKS) -> Envelope:
        """Findings that hold, of the current generation; refuses a stale index.

        ``router`` are candidates from outside; with ``routing`` the provider names
        them.  Without ``factory`` the offline lexical extractor finds lines.  Only candidates' files
        are read, once.  Chunks are sent ``wave`` at a time under one cap.
        """
        with self.work() as staged:
            opened = self.store.open()
            if not opened:
                return Envelope("query", "index_missing", {"hint": "build the index first"})
            stale = self._staleness(staged)
            if stale["stale"]:
                return Envelope("query", "index_stale", stale)
            out = self._query(staged, opened[0], text, factory, router, routing, mode, window, cap, max_usd, budget_tokens, wave)
        if out.state != "unanswered" or "dropped" in out.data:
            self.store.keep_run(asdict(out))
        if factory:
            self.store.delete(self.answers_at(text))
        return out

    def texts(self, picked: DataFrame) -> DataFrame:
        """The corpus's files among ``picked`` (path), with text."""
        if not self.tree:
            return corpus.accepted(self.files()).join(picked.select("path"), "path", "left_semi")
        return corpus.accepted(self.tree.read(self.tree.meta().join(picked.select("path"), "path", "left_semi")))

    def _query(self, staged: Staged, generation: str, text: str, factory: Callable[[], seam.Provider] | None, router: DataFrame | None, routing: bool, mode: str, window: int, cap: int, max_usd: float | None, budget_tokens: int | None, wave: int) -> Envelope:
        cards = self.store.table(generation, "cards")
        none = self.spark.createDataFrame([], "path string, router_rank int, look_for string")
        if router is None and factory and routing:
            router = seam.route(cards, factory, text)
        known = (router if router is not None else none).join(cards.select("path"), "path", "left_semi")
        merged = staged.write(route.merge(known, self.candidates(generation, text)))
        files = staged.write(self.texts(merged))
        chosen = files.join(merged, "path")
        ranked = chunk.rank_chunks(chunk.chunks(chosen, mode, window), text, cap)
        cost = token_estimate(F.col("body")) / 1e6 * fixed.USD_IN + 0.006
        place = F.row_number().over(Window.orderBy(F.asc_nulls_last("router_rank"), F.desc("score"), "path", "first_line"))  # at most ``cap`` chunks
        ranked = staged.write(ranked.withColumn("cost", cost).withColumn("place", place))
        n, top = ranked.agg(F.count(F.lit(1)), F.max("score")).first()
        if not n:
            return Envelope("query", "unanswered", {"findings": []})
        if factory:
            send = lambda rows, left: seam.ask(rows, factory, text, ledger=self.ledger(text), left_usd=left)
            answers, late, spend = seam.in_waves(ranked, F.floor((F.col("place") - 1) / wave), F.col("cost"), max_usd, send, staged.write)
            nothing = self.spark.createDataFrame([], "path string, first_line int, raw string, in_tok long, out_tok long, retries long, error string")
            answers = answers if answers is not None else nothing
            found, failed = seam.findings_of(answers, ranked), seam.failures_of(answers)
        else:
            admitted = chunk.admitted(ranked, "cost", max_usd, ["place"]) if max_usd is not None else ranked.withColumn("admitted", F.lit(True))
            late, spend, failed = admitted.where("not admitted"), {}, None
            found = seam.lexical_findings(admitted.where("admitted"), route.query_terms(self.spark, text))
        refused = late.select("path", F.col("first_line").alias("line"), F.lit(None).cast("string").alias("fact"), F.lit(None).cast("string").alias("quote"), F.lit("budget_hit_before_chunk").alias("reason"))
        failed = failed.unionByName(refused) if failed is not None else refused
        checked = staged.write(firewall.verify(found, files))
        held, gone = firewall.passed(checked), firewall.dropped(checked).select("path", "line", "fact", "quote", "reason").unionByName(failed)
        claim = firewall.holds_claim(F.lit(text), F.col("quote"))
        gone = gone.unionByName(held.where(~claim).select("path", "line", "fact", "quote", F.lit("partial_claim_match").alias("reason")))
        held = firewall.distinct(held.where(claim))
        best = held.orderBy(*firewall.in_order(held))
        if budget_tokens is not None:
            best = packed(held, budget_tokens)
        findings = [r.asDict() for r in best.collect()]
        drops = [r.asDict() for r in gone.collect()]
        weak = bool(findings) and max(f["score"] for f in findings) < (top or 0.0) * fixed.WEAK_RATIO
        state = self.spark.range(1).select(report.query_state(F.lit(False), F.lit(n), F.lit(len(findings)), F.array(*[F.lit(d["reason"]) for d in drops]) if drops else F.array().cast("array<string>"))).first()[0]
        return Envelope("query", state, {"findings": findings, "dropped": drops, "weak_signal": weak, "generation": generation}, spend)

    def brief(self, budget_tokens: int | None = None) -> Envelope:
        """The module map, entry points and coverage; staleness is told, not enforced.

        With a budget only as much of the map as that holds leaves the executors.
        """
        opened = self.store.open()
        if not opened:
            return Envelope("brief", "index_missing", {"hint": "build the index first"})
        mine, skipped = self.store.table(opened[0], "cards"), self.store.table(opened[0], "skipped")
        plain = lambda df: [r.asDict(True) for r in df.collect()]
        dirs: dict[str, list] = {}
        if budget_tokens is None:
            dirs = {r["dir"]: r["files"] for r in plain(cards_.module_map(mine).orderBy("dir"))}
        else:
            for r in plain(cards_.map_within(mine, 4 * budget_tokens).orderBy("dir", "entry.path")):
                dirs.setdefault(r["dir"], []).append(r["entry"])
        data = {
            "generation": opened[0],
            "module_map": dirs,
            "entry_points": plain(cards_.entry_points(mine).select("path", "role", F.size("imports").alias("imports"), "churn", "harness_meta")),
            "coverage": plain(report.coverage(skipped)),
            **self.staleness(),
        }
        if budget_tokens is not None:
            # a map that was cut reaches the budget by itself, so that its end is never seen
            text = self.spark.range(1).select(report.truncated(F.lit(json.dumps(data)), budget_tokens)).first()[0]
            data = json.loads(text)
        return Envelope("brief", data=data)

    def evaluate(self, suite: DataFrame, max_usd: float | None = None, **options) -> Envelope:
        """Runs a golden suite, scores it and keeps each query's envelope and a summary.

        Once ``max_usd`` is spent no further query is asked, and the suite counts
        as incomplete.
        """
        runs, kept, spent, folder = [], [], 0.0, f"eval-runs/{int(time.time() * 1000)}"
        rows = suite.collect()
        for q in rows:
            if max_usd is not None and spent >= max_usd:
                break
            got = self.query(q["query"], max_usd=None if max_usd is None else max_usd - spent, **options)
            name = f"{folder}/{q['id']}.json"
            self.store.write(name, json.dumps(asdict(got)))
            found = [{"query_id": q["id"], "file": f["path"], "line": f["line"], "fact": f["fact"]} for f in got.data.get("findings", [])]
            facts = [{"query_id": q["id"], "file": m["file"], "line": m["line"], "fact": m["fact"]} for m in q["must_find"] or []]
            bad = [{"query_id": q["id"], "id": p["id"], "query": q["query"], "poison": p["fact"]} for p in q["poison"] or []]
            frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
            f = frame(found, "query_id string, file string, line int, fact string")
            m = frame(facts, "query_id string, file string, line int, fact string")
            hit = evalkit.covered(m, f).where("covered").count() if facts else 0
            files = {x["file"] for x in found}
            alive = evalkit.survivors(frame(bad, "query_id string, id string, query string, poison string"), f).where("survives").count() if bad else 0
            usd = float(got.spend.get("usd", 0.0))
            run = (len({x["file"] for x in facts} & files), len({x["file"] for x in facts}), hit, len(facts), alive, bool(q["negative"]), len(found), usd, got.state in ("ok", "partial", "unanswered"))
            spent += usd
            runs.append(run)
            kept.append({"id": q["id"], "state": got.state, "artifact": name, "recall": run[:2], "covered": run[2:4], "poison_survivors": alive, "negative_clean": not (q["negative"] and found)})
        out = Envelope("eval", spend={"usd": spent})
        if runs:
            schema = "recall_found int, recall_total int, covered int, facts int, poison int, negative boolean, findings int, usd double, complete boolean"
            out.data = evalkit.gates(self.spark.createDataFrame(runs, schema)).first().asDict()
        if len(runs) < len(rows) or not runs:
            out.data |= {"complete": False, "green": False}
        out.data |= {"asked": len(runs), "queries": len(rows), "summary": f"{folder}/summary.json"}
        self.store.write(out.data["summary"], json.dumps({"metrics": out.data, "spend": out.spend, "queries": kept}))
        if not out.data["green"]:
            out.state = "partial"
        return out


def index_tables(made: DataFrame, drafts: DataFrame, skipped: DataFrame) -> dict[str, DataFrame]:
    """A generation's tables from its cards, with what the drafts know besides.

    ``meta`` has a row for each file that was opened, one that its content left out too.
    """
    read = drafts.where("skip_reason is null or skip_reason in ('decode_error', 'binary_nul', 'unsupported_or_tool_missing')")
    meta = read.select("path", F.when(F.col("skip_reason").isNull(), F.col("hash")).alias("hash"), "size", "mtime_ms", "skip_reason")
    return {"cards": made.select(*cards_.STORED), "terms": cards_.term_sets(made), "meta": meta, "skipped": skipped}


def posted(table: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The inverted index of a generation's terms."""
    rows = postings.postings(table("terms"))
    return {"postings": rows, "counts": postings.counts(rows)}


def packed(findings: DataFrame, budget_tokens: int) -> DataFrame:
    """``findings`` of one query in their final order, quotes beyond the budget left out."""
    place = F.row_number().over(Window.orderBy(*firewall.in_order(findings)))  # a query's findings
    full, short = F.to_json(F.struct("path", "line", "fact", "quote")), F.to_json(F.struct("path", "line", "fact"))
    item = F.struct(place.alias("place"), token_estimate(full).alias("full"), token_estimate(short).alias("reduced"), F.struct(*findings.columns).alias("f"))
    all_ = findings.select(item.alias("i")).agg(F.array_sort(F.collect_list("i"), lambda a, b: a["place"] - b["place"]).alias("items"))
    out = all_.select(F.posexplode(F.arrays_zip(F.col("items.f").alias("f"), report.pack(F.col("items"), "full", "reduced", budget_tokens).alias("omitted"))).alias("at", "z")).orderBy("at")
    cols = [F.col(f"z.f.{c}").alias(c) for c in findings.columns if c != "quote"]
    return out.select(*cols, F.when(~F.col("z.omitted"), F.col("z.f.quote")).alias("quote"), F.col("z.omitted").alias("quote_omitted"))


def compact(envelope: Envelope) -> dict:
    """The envelope for reading: findings without scores, drops as counts by reason."""
    data = dict(envelope.data)
    data["findings"] = [{k: f.get(k) for k in ("path", "line", "fact", "quote", "match_tier") if f.get(k) is not None} for f in data.get("findings", [])]
    counts: dict[str, int] = {}
    for d in data.pop("dropped", []):
        counts[d["reason"]] = counts.get(d["reason"], 0) + 1
    return {"state": envelope.state, "command": envelope.command, "data": data | {"dropped_reasons": dict(sorted(counts.items()))}, "spend": envelope.spend}


def capabilities() -> dict:
    return {"commands": list(fixed.COMMANDS), "states": dict(fixed.STATES), "chunk_modes": list(chunk.MODES), "limits": {"file_bytes": fixed.MAX_FILE_BYTES, "candidates": fixed.CANDIDATES, "chunk_cap": fixed.CHUNK_CAP}}


def schema() -> dict:
    """What the answers' fields mean."""
    return {
        "envelope": {"schema": Envelope("").schema, "state": "|".join(fixed.STATES), "data": "by command", "spend": "calls, tokens, retries, usd", "skipped": "files left out", "errors": "messages"},
        "exit_codes": dict(fixed.STATES),
        "card_schema_version": cards_.SCHEMA_VERSION,
        "finding": {"path": "relative path", "line": "line of the source, from 1", "fact": "the extractor's sentence", "quote": "verbatim, unless left out", "quote_omitted": "true when it was left out for the budget", "match_tier": "how the quote was found", "score": "with --full only", "router_rank": "with --full only"},
        "query_data": {"weak_signal": f"the best finding scores under {fixed.WEAK_RATIO} of the best candidate", "dropped": "with reasons; counts by reason unless --full", "changed_files": "of a stale index"},
        "brief_data": {"stale": "boolean", "reason": "current|manifest_mismatch|content_hash_mismatch", "changed_files": "against the manifest"},
        "runs": "last_run.json and runs/*.json hold whole envelopes of queries, eval-runs/*/summary.json those of suites",
    }
