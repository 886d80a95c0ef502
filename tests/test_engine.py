"""Commands end to end on a small corpus, the store, the seam and the stream."""

import json

import pytest

from cartulary.__main__ import budget, hint, main
from cartulary.plans import provider
from cartulary.plans.engine import Engine, compact, packed
from cartulary.plans.store import Busy, Generations
from cartulary.sources import corpus
from cartulary.sources.rules import rules_of
from cartulary.sources.tree import Directory
from cartulary.streaming.incremental import follow

TEXTS = {
    "docs/cache.md": "# Caching\nThe cache expires entries after one hour.\nEviction is lazy.\n",
    "docs/auth.md": "# Auth\nSessions live in the browser.\n",
    "src/lib.rs": "use std::io;\npub fn evict(cache: Cache) {\n}\n",
    ".env": "KEY=1\n",
    "node_modules/x.md": "no\n",
    "img/a.png": "no\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    for name, text in TEXTS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture
def engine(spark, tree, tmp_path):
    return Engine(spark, Directory(spark, str(tree)), str(tmp_path / "store"))


def test_index_query_refresh(engine, tree):
    assert engine.query("cache").state == "index_missing"
    first = engine.index()
    assert first.state == "ok" and first.data["cards"] == 3 and first.data["files_to_card"] == 3
    reasons = {r["path"]: r["reason"] for r in engine.store.table(first.data["generation"], "skipped").collect()}
    assert reasons == {".env": "sensitive", "img/a.png": "binary_or_unsupported"}
    assert not engine.staleness()["stale"]
    got = engine.query("when does the cache expire entries")
    assert got.state == "ok" and got.data["findings"][0]["path"] == "docs/cache.md" and got.data["findings"][0]["line"] == 2
    (tree / "docs/auth.md").write_text("# Auth\nSessions live in Redis.\n")
    assert engine.query("cache").state == "index_stale" and engine.staleness()["changed_files"] == 1
    again = engine.refresh()
    assert again.data["files_to_card"] == 1 and again.data["generation"] != first.data["generation"]
    assert engine.query("zebra quagga").state == "unanswered"
    brief = engine.brief()
    assert set(brief.data["module_map"]) == {"docs", "src"} and brief.data["entry_points"][0]["path"] == "src/lib.rs"


def test_index_stops_at_the_cap(engine):
    assert engine.index(max_usd=0.0).state == "budget_hit" and engine.store.open() is None


def told():
    """A provider's factory, made here so that workers get it by value."""

    class Told:
        def answer(self, system, user, max_tokens):
            line = "The cache expires entries after one hour."
            if line in user:
                return provider.Answer(json.dumps([{"fact": "one hour", "line": 2, "quote": line}, {"fact": "made up", "line": 2, "quote": "never said"}]), 10, 5)
            if "Auth" in user:
                raise provider.ProviderError("down")
            return provider.Answer("no json", 1, 1)

    return Told


def test_provider_findings_pass_the_firewall(engine):
    engine.index()
    got = engine.query("cache entries expire sessions evict", factory=told())
    assert [f["fact"] for f in got.data["findings"]] == ["one hour"] and got.state == "partial"
    reasons = sorted(d["reason"] for d in got.data["dropped"])
    assert reasons[0] == "provider_error: down" and "quote_not_in_file" in reasons and any(r.startswith("unparseable") for r in reasons)
    assert got.spend["calls"] == 4


def test_provider_writes_cards_and_routes(engine, spark):
    def made():
        class Writer:
            def answer(self, system, user, max_tokens):
                if "QUESTION" in user:
                    return provider.Answer(json.dumps({"files": [{"path": "docs/auth.md", "rank": 1, "look_for": "browser"}, {"path": "invented.md", "rank": 2}]}), 3, 3)
                if "cache.md" in user:
                    return provider.Answer(json.dumps({"role": " all about caching ", "invariants": list("abcdefghij"), "gotchas": [], "terms": ["ttl"]}), 7, 2)
                if "lib.rs" in user:
                    raise provider.ProviderError("down")
                return provider.Answer("no json", 1, 1)

        return Writer

    got = engine.index(factory=made())
    assert got.state == "partial" and got.spend["calls"] == 3 and got.spend["in_tok"] == 8
    rows = {r["path"]: r for r in engine.store.table(got.data["generation"], "cards").collect()}
    assert set(rows) == {"docs/cache.md", "docs/auth.md"}
    assert rows["docs/cache.md"]["role"]["value"] == "all about caching" and len(rows["docs/cache.md"]["invariants"]["value"]) == 8
    assert rows["docs/auth.md"]["role"]["value"] == "Auth"
    again = engine.index()
    rows = {r["path"]: r for r in engine.store.table(again.data["generation"], "cards").collect()}
    assert again.data["files_to_card"] == 1 and rows["docs/cache.md"]["terms"]["value"] == ["ttl"] and len(rows) == 3
    routed = provider.route(engine.store.table(again.data["generation"], "cards"), made(), "q").collect()
    assert [tuple(r) for r in routed] == [("docs/auth.md", 1, "browser")]
    short = compact(engine.query("cache entries expire"))
    assert short["data"]["findings"] and "dropped" not in short["data"]


def test_budget_refuses_chunks(engine):
    engine.index()
    got = engine.query("cache entries expire sessions evict", max_usd=0.007)
    assert got.state == "partial" and any(d["reason"] == "budget_hit_before_chunk" for d in got.data["dropped"])


def test_quotes_are_left_out_beyond_the_budget(engine):
    engine.index()
    got = engine.query("cache entries expire", budget_tokens=201)
    assert all(f["quote"] is None and f["quote_omitted"] for f in got.data["findings"])


def test_evaluation(engine, spark, tmp_path):
    engine.index()
    suite = {"queries": [
        {"id": "a", "query": "when does the cache expire entries", "must_find": [{"id": "1", "fact": "cache entries expire", "file": "docs/cache.md", "line": 2}], "poison": [{"id": "p", "fact": "Redis expires cache entries"}]},
        {"id": "b", "query": "zebra quagga", "must_find": [], "poison": [], "negative": True},
    ]}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps(suite))
    got = engine.evaluate(corpus.suite(spark, str(path))).data
    assert got["recall_pct"] == 100 and got["coverage_pct"] == 100 and got["poison"] == 0 and got["green"]


def test_store_is_pinned_pruned_and_locked(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "s"))
    df = spark.range(3)
    names = [store.publish({"t": df}, {"n": i}) for i in range(5)]
    kept = [n for n in store.names() if n.startswith("gen-")]
    assert kept == sorted(names[-3:]) and store.open() == (names[-1], {"n": 4})
    assert store.table(names[-1], "t").count() == 3
    store.write("build.lock", json.dumps({"pid": -1, "started_at_ms": 10_000}))
    with pytest.raises(Busy):
        store.lock(now_ms=20_000)
    store.lock(now_ms=10_000 + 16 * 60 * 1000)
    store.write("build.lock", "torn")
    with pytest.raises(Busy):
        store.lock()


def test_bucket_and_backoff():
    now = [0.0]
    bucket = provider.Bucket(60, lambda: now[0])
    assert all(bucket.wait_s() == 0 for _ in range(60)) and bucket.wait_s() > 0
    now[0] += 1
    assert bucket.wait_s() == 0
    assert provider.backoff_s(3, lambda a, b: b) == 8 and provider.backoff_s(9, lambda a, b: b) == 60


def test_stream_makes_generations(spark, tmp_path):
    source, top = tmp_path / "in", str(tmp_path / "store")
    put = lambda rows: spark.createDataFrame(rows, "path string, text string").write.mode("append").parquet(str(source))
    put([("a.md", "# A\nx"), ("b.md", "b"), (".env", "k")])
    follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(60)
    put([("b.md", "b changed"), ("c.md", "c")])
    follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(60)
    store = Generations(spark, top)
    name, _ = store.open()
    assert sorted(r["path"] for r in store.table(name, "cards").collect()) == ["a.md", "b.md", "c.md"]
    hashes = {r["path"]: r["hash"] for r in store.table(name, "meta").collect()}
    assert len(set(hashes.values())) == 3 and store.table(name, "skipped").count() == 1


def test_ignore_rules_and_command_line(spark, tree, capsys):
    rows = Directory(spark, str(tree), ignore=["*.rs", "docs/", "!docs/auth.md", ".env"])().collect()
    assert sorted(r["path"] for r in rows) == [".env", "docs/auth.md", "img/a.png"]
    assert hint("indx") == "index" and hint("index") is None and hint("a question") is None and hint("evl") == "eval"
    assert budget("8k") == 8000 and budget("12") == 12
    assert main(["indx"]) == 2 and "index" in capsys.readouterr().out
    assert main(["capabilities"]) == 0


def test_tool_and_secret_directories_are_one_row_each_and_denied_files_are_not_opened(spark, tmp_path):
    for name, text in {"a.md": "# A", ".claude/x.md": "x", ".aws/c1": "secret", ".aws/c2": "secret", "sub/.ssh/id": "k", ".hidden.md": "kept", ".env": "SECRET=1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for denied in (".env", ".aws/c1", ".aws/c2", "sub/.ssh/id"):
        (tmp_path / denied).chmod(0)
    rows = {r["path"]: (r["skip_reason"], r["text"]) for r in Directory(spark, str(tmp_path))().collect()}
    assert rows == {"a.md": (None, "# A"), ".hidden.md": (None, "kept"), ".claude": ("harness_meta", None), ".aws": ("sensitive", None), "sub/.ssh": ("sensitive", None), ".env": ("sensitive", None)}
    table = spark.createDataFrame([("a.md", "t", "markdown"), (".claude/x", "t", "code"), (".claude/y", "t", "code"), ("b.md", "\0", "markdown")], "path string, text string, adapter string")
    left = {(r["path"], r["reason"]) for r in corpus.rejected(corpus.walk(table)).collect()}
    assert left == {(".claude", "harness_meta"), ("b.md", "binary_nul")}


def test_packed_findings_keep_their_order(spark):
    rows = [(f"p{i}.md", 1, "fact", "quote " * 20, i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows[::-1], "path string, line int, fact string, quote string, router_rank int, score double").repartition(5)
    got = packed(df, 400).collect()
    assert [r["path"] for r in got] == [r[0] for r in rows] and not got[0]["quote_omitted"] and got[-1]["quote_omitted"]


def test_a_small_brief_is_truncated_and_rates_are_shared():
    from cartulary.functions import fixed

    assert provider.PARALLEL * (fixed.CALLS_PER_MINUTE / provider.PARALLEL) == fixed.CALLS_PER_MINUTE
    assert provider.HttpProvider.__init__.__defaults__ == (fixed.CALLS_PER_MINUTE / provider.PARALLEL,)


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_ignore_files_of_the_tree(spark, tmp_path):
    root = tmp_path / "repo" / "corpus"
    put(tmp_path / "repo", {".git/config": "", ".git/info/exclude": "excluded.md\n", ".gitignore": "above.md\n/corpus/anchored.md\n"})
    put(root, {
        ".gitignore": "# a comment\n*.log\n/only_top.md\nbuild_out/\n!keep.log\ndeep/**/x.md\nq?.md\n[ab]1.md\n\\#odd.md\n",
        "docs/.gitignore": "b.md\n!loud.log\n", ".ignore": "!excluded.md\n", "sub/.cartularyignore": "c.md\n", ".hidden/.ignore": "no.md\n",
        "a.log": "", "keep.log": "k", "docs/loud.log": "l", "only_top.md": "", "docs/only_top.md": "o", "build_out/keep.log": "", "docs/build_out": "file",
        "deep/x.md": "", "deep/1/2/x.md": "", "deep/1/y.md": "y", "q1.md": "", "a1.md": "", "c1.md": "c", "#odd.md": "", "docs/b.md": "", "b.md": "b",
        "sub/c.md": "", "c.md": "c", "above.md": "", "anchored.md": "", "docs/anchored.md": "d", "excluded.md": "e", ".hidden/no.md": "", ".hidden/yes.md": "y", "docs/.env": "S=1",
    })
    rows = {r["path"]: r for r in Directory(spark, str(root))().collect()}
    config = {".gitignore", "docs/.gitignore", ".ignore", "sub/.cartularyignore", ".hidden/.ignore"}
    assert set(rows) - config == {
        "keep.log", "docs/loud.log", "docs/only_top.md", "docs/build_out", "deep/1/y.md", "c1.md", "b.md", "c.md", "docs/anchored.md", "excluded.md", ".hidden/yes.md", "docs/.env",
    }
    assert rows[".hidden/yes.md"]["text"] == "y" and rows["docs/.env"]["skip_reason"] == "sensitive" and rows["docs/.env"]["text"] is None


def test_gitignore_needs_a_version_controlled_tree(spark, tmp_path):
    put(tmp_path, {".gitignore": "a.md\n", ".ignore": "b.md\n", "a.md": "a", "b.md": "b"})
    assert {r["path"] for r in Directory(spark, str(tmp_path))().collect()} == {".gitignore", ".ignore", "a.md"}
    assert [r.keep for r in rules_of("!a\n\n# no\n   \nb/ \n")] == [True, False]


def test_streamed_and_built_indexes_go_on_from_each_other(spark, tmp_path):
    source, top = tmp_path / "in", str(tmp_path / "store")
    texts = {"a.md": "# A\nalpha words", "b.md": "# B\nbeta words"}
    table = lambda: spark.createDataFrame(list(texts.items()), "path string, text string")
    files = lambda: corpus.walk(table().withColumn("adapter", corpus.paths.adapter(corpus.F.col("path"))))
    engine = Engine(spark, files, top)

    def made():
        class Writer:
            def answer(self, system, user, max_tokens):
                return provider.Answer(json.dumps({"role": "written by a model"}), 1, 1)

        return Writer

    engine.index(factory=made())
    spark.createDataFrame([("b.md", texts["b.md"]), ("c.md", "# C\ngamma")], "path string, text string").write.mode("append").parquet(str(source))
    follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(60)
    texts["c.md"] = "# C\ngamma"
    assert not engine.staleness()["stale"] and engine.query("gamma").state == "ok"
    roles = {r["path"]: r["role"]["value"] for r in engine.store.table(engine.store.open()[0], "cards").collect()}
    assert roles == {"a.md": "written by a model", "b.md": "written by a model", "c.md": "C"}
    assert engine.index().data["files_to_card"] == 0


def test_a_dead_process_loses_its_lock(spark, tmp_path):
    import socket
    import subprocess
    import sys

    store = Generations(spark, str(tmp_path / "s"))
    gone = subprocess.Popen([sys.executable, "-c", ""])
    gone.wait()
    store.write("build.lock", json.dumps({"pid": gone.pid, "host": socket.gethostname(), "started_at_ms": 10_000}))
    store.lock(now_ms=20_000)
    store.write("build.lock", json.dumps({"pid": 1, "host": socket.gethostname(), "started_at_ms": 10_000}))
    with pytest.raises(Busy):
        store.lock(now_ms=20_000)
    store.write("build.lock", json.dumps({"pid": gone.pid, "host": "elsewhere", "started_at_ms": 10_000}))
    with pytest.raises(Busy):
        store.lock(now_ms=20_000)


def test_refresh_and_index_ask_before_they_spend(engine, monkeypatch):
    seen = []
    out = engine.index(confirm=lambda cost: seen.append(cost) or False)
    assert out.state == "budget_hit" and out.data["cancelled"] and seen[0]["n"] == 3 and engine.store.open() is None
    assert engine.refresh(max_usd=0.0).state == "budget_hit"
    monkeypatch.setattr("cartulary.functions.fixed.REFRESH_USD", 0.0)
    got = engine.refresh()
    assert got.state == "budget_hit" and got.data["changed_files"] == 3 and engine.store.open() is None


def test_evaluation_stops_at_the_cap_and_keeps_a_summary(engine, spark):
    engine.index()
    rows = [(i, "cache entries expire", [], [], False) for i in "ab"]
    suite = spark.createDataFrame(rows, "id string, query string, must_find array<struct<id:string,fact:string,file:string,line:int>>, poison array<struct<id:string,fact:string>>, negative boolean")
    whole = engine.evaluate(suite)
    summary = json.loads(engine.store.read(whole.data["summary"]))
    assert [q["id"] for q in summary["queries"]] == ["a", "b"] and json.loads(engine.store.read(summary["queries"][0]["artifact"]))["command"] == "query"
    none = engine.evaluate(suite, max_usd=0.0)
    assert none.state == "partial" and none.data["asked"] == 0 and not none.data["complete"] and not none.data["green"]


def test_no_retry_beyond_the_cap(monkeypatch):
    for name in ("CARTULARY_URL", "CARTULARY_MODEL", "CARTULARY_KEY"):
        monkeypatch.setenv(name, "http://127.0.0.1:1/x")
    monkeypatch.setattr(provider, "backoff_s", lambda attempt: 0.0)
    capped = provider.HttpProvider(6000, most_usd=0.0)
    with pytest.raises(provider.ProviderError, match="before provider retry"):
        capped.answer("s", "u", 1)


def test_changes_of_version_control(spark, tmp_path):
    import shutil
    import subprocess

    assert corpus.version_control_churn(spark, str(tmp_path)) is None
    if not shutil.which("git"):
        return
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init")
    for i in range(2):
        put(tmp_path, {"a.md": str(i), f"sub/b{i}.md": "x"})
        git("add", ".")
        git("commit", "-m", "x")
    rows = {tuple(r) for r in corpus.version_control_churn(spark, str(tmp_path)).collect()}
    assert rows == {("a.md", 2), ("sub/b0.md", 1), ("sub/b1.md", 1)}
    assert {tuple(r) for r in corpus.version_control_churn(spark, str(tmp_path / "sub")).collect()} == {("b0.md", 1), ("b1.md", 1)}


def test_schema_and_usage(capsys):
    assert main(["schema"]) == 0 and "finding" in json.loads(capsys.readouterr().out)
    assert main(["eval", "."]) == 2 and main(["help"]) == 0
