"""The directory's listing, what is opened, the inverted index, layers, paid answers and caps."""

import ctypes
import json
import os
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.operators import cards, postings, route
from cartulary.plans import provider
from cartulary.plans.engine import Engine
from cartulary.plans.store import Generations
from cartulary.sources import corpus
from cartulary.sources.tree import Directory, closed
from cartulary.streaming.incremental import follow


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


class Opens:
    """Files opened below a folder, told by the kernel."""

    def __init__(self, root):
        self.libc, self.root, self.at = ctypes.CDLL(None, use_errno=True), str(root), {}
        self.fd = self.libc.inotify_init1(os.O_NONBLOCK)
        for d, _, _ in os.walk(root):
            self.at[self.libc.inotify_add_watch(self.fd, d.encode(), 0x20)] = os.path.relpath(d, root)

    def seen(self):
        out = Counter()
        while True:
            try:
                data = os.read(self.fd, 1 << 20)
            except BlockingIOError:
                return out
            i = 0
            while i < len(data):
                wd, mask, _, n = struct.unpack_from("iIII", data, i)
                name = data[i + 16 : i + 16 + n].rstrip(b"\0").decode()
                if name and not mask & 0x40000000:
                    out[os.path.normpath(f"{self.at[wd]}/{name}")] += 1
                i += 16 + n


FILES = {
    "a.md": "# Alpha\nThe cache expires entries after one hour.\n", "docs/b.md": "# Beta\nSessions live in the browser.\n", "docs/deep/c.rs": "pub fn evict() {}\n",
    ".hidden/d.md": "# Delta\nhidden words about eviction\n", "_under/e.md": "# E\n", "server.pem": "secret", "docs/id_rsa": "secret", ".aws/keys": "secret", ".env.d/x": "secret", ".config/gcloud/y": "secret",
    "img/p.png": "no", "node_modules/m.md": "no", "big.md": "x" * 300_001, "nul.md": "a\0b", "skipped.md": "no", "out/o.md": "no", "out/k.pem": "secret", ".ignore": "skipped.md\nout/\n", "credentials/readme.md": "# C\nplain\n",
}
KEPT = {"a.md", "docs/b.md", "docs/deep/c.rs", ".hidden/d.md", "_under/e.md", ".ignore", "credentials/readme.md"}
DENIED = {"server.pem": "sensitive", "docs/id_rsa": "sensitive", ".aws": "sensitive", ".env.d": "sensitive", ".config/gcloud": "sensitive", "out/k.pem": "sensitive", "img/p.png": "binary_or_unsupported", "big.md": "too_large", "nul.md": "binary_nul"}


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "corpus", FILES)
    return tmp_path / "corpus"


def test_listing_is_one_row_each_and_denied_names_are_never_opened(spark, root):
    opens = Opens(root)
    rows = [(r["path"], r["skip_reason"]) for r in Directory(spark, str(root))().collect()]
    assert sorted(rows, key=str) == sorted([*((p, None) for p in KEPT), *DENIED.items()], key=str)
    seen = opens.seen()
    assert set(seen) == KEPT | {"nul.md"} and all(seen[p] == 1 for p in seen if p != ".ignore")
    assert closed("a/.AWS") and closed(".config/gcloud") and not closed(".config") and closed("x/.env.local")


def test_an_index_reads_once_and_an_unchanged_tree_is_current_unread(spark, root, tmp_path):
    engine = Engine(spark, Directory(spark, str(root)), str(tmp_path / "store"))
    opens = Opens(root)
    assert engine.index().data["cards"] == len(KEPT)
    seen = opens.seen()
    assert all(seen[p] == 1 for p in (KEPT | {"nul.md"}) - {".ignore"}) and not set(seen) & set(DENIED) - {"nul.md"}
    assert engine.staleness() == {"stale": False, "reason": "current", "changed_files": 0}
    assert set(opens.seen()) <= {".ignore"}
    # another time, the same content: read, and found unchanged
    os.utime(root / "a.md", (1, 1))
    os.utime(root / "nul.md", (1, 1))
    assert not engine.staleness()["stale"] and set(opens.seen()) - {".ignore"} == {"a.md", "nul.md"}
    # other content of the same size is told by its hash, another size without reading
    text = FILES["docs/b.md"].replace("browser", "Browser")
    (root / "docs/b.md").write_text(text)
    os.utime(root / "docs/b.md", (2, 2))
    assert engine.staleness()["changed_files"] == 1
    (root / "docs/b.md").write_text(text + "more")
    opens.seen()
    assert engine.staleness()["changed_files"] == 1 and "docs/b.md" not in opens.seen()
    # gone and new
    (root / "docs/deep/c.rs").unlink()
    put(root, {"new.md": "n"})
    assert engine.staleness()["changed_files"] == 3


def test_a_question_opens_its_candidates_alone(spark, root, tmp_path):
    engine = Engine(spark, Directory(spark, str(root)), str(tmp_path / "store"))
    engine.index()
    opens = Opens(root)
    got = engine.query("when are cache entries gone")
    assert got.state == "ok" and got.data["findings"][0]["path"] == "a.md"
    assert {p: n for p, n in opens.seen().items() if p != ".ignore"} == {"a.md": 1}


def test_tool_directories_do_not_make_an_index_stale(spark, tmp_path):
    root = tmp_path / "corpus"
    put(root, {"a.md": "# A\ncache entries expire"} | {f"{tool}/rules.md": "cache entries expire" for tool in fixed.TOOL_DIRS})
    engine = Engine(spark, Directory(spark, str(root)), str(tmp_path / "store"))
    assert engine.index(factory=made("{}")).data["cards"] == 1
    skipped = [tuple(r) for r in engine.store.table(engine.store.open()[0], "skipped").select("path", "reason").collect()]
    assert sorted(skipped) == sorted((tool, "harness_meta") for tool in fixed.TOOL_DIRS) and not engine.staleness()["stale"]
    assert engine.query("cache entries").state == "ok" and engine.refresh().data == {"refreshed": False} and not engine.brief().data["stale"]


def test_changed_rules_make_an_index_stale(spark, root, tmp_path):
    engine = Engine(spark, Directory(spark, str(root)), str(tmp_path / "store"))
    engine.index()
    put(root, {"docs/.ignore": "deep/\n"})
    assert engine.staleness()["reason"] == "manifest_mismatch"
    assert engine.index().data["cards"] == len(KEPT)  # without deep/c.rs, with docs/.ignore


def sets(spark, texts):
    df = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path")))
    return cards.own_term_sets(df)


def test_postings_give_the_same_candidates_from_their_own_buckets(spark, tmp_path):
    texts = {f"d{i % 7}/cache_{i}.md": " ".join(f"word{j}" for j in range(i % 5, 40, i % 4 + 1)) + (" cache expires" if i % 3 else "") for i in range(60)}
    terms = sets(spark, texts)
    terms.write.parquet(str(tmp_path / "terms"))
    stored = spark.read.parquet(str(tmp_path / "terms"))
    rows = postings.postings(stored)
    rows.write.partitionBy("bucket").parquet(str(tmp_path / "postings"))
    posted = spark.read.parquet(str(tmp_path / "postings"))
    postings.counts(posted).write.partitionBy("bucket").parquet(str(tmp_path / "counts"))
    known = spark.read.parquet(str(tmp_path / "counts"))
    for query in ("cache word3 word17", "when does the cache expire", "nothing here", "the of", "cache_5", "d3/cache_1", "word4 word4"):
        want = [tuple(r) for r in route.candidates(spark, terms, query).collect()]
        for counted in (known, None):
            assert [tuple(r) for r in postings.candidates(spark, posted, stored.select("path"), query, counted).collect()] == want, query
    needed = postings.wanted(spark, "cache word3")
    plan = postings.of_terms(posted, needed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan
    files = postings.of_terms(posted, needed).select(F.input_file_name()).distinct().collect()
    assert {int(r[0].split("bucket=")[1].split("/")[0]) for r in files} == {b for _, b in needed}


def test_layers_follow_the_batch_and_equal_a_full_build(spark, tmp_path):
    source, top = tmp_path / "in", str(tmp_path / "store")
    push = lambda texts: spark.createDataFrame(list(texts.items()), "path string, text string").coalesce(1).write.mode("append").parquet(str(source))
    texts = {f"d/f{i}.md": f"# File {i}\n" + " ".join(f"term{i}x{j}" for j in range(300)) for i in range(80)} | {".env": "k", ".claude/x.md": "x"}
    push(texts)
    follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(120)
    store = Generations(spark, top)
    base = store.open()[0]
    batches = [{"d/f1.md": "# File 1\nchanged words", "new.md": "# New\nbrand"}, {"new.md": "# New\nagain", "d/f2.md": "a\0b"}, {"d/f1.md": "# One\nlast", ".claude/y.md": "y"}]
    for batch in batches:
        push(batch)
        follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(120)
        texts |= batch
    name = store.open()[0]
    assert len(store.layers(name)) == 4 and all(store.bytes(layer) < store.bytes(base) / 3 for layer in store.layers(name)[1:])
    files = lambda: corpus.walk(spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path"))))
    full = Engine(spark, files, str(tmp_path / "full"))
    full.index()
    whole = full.store.open()[0]
    same = lambda a, b: {str(r) for r in a.collect()} == {str(r) for r in b.collect()} and a.count() == b.count()
    for t, columns in {"cards": cards.STORED, "terms": ("path", "terms"), "meta": ("path", "hash", "skip_reason"), "skipped": ("path", "reason"), "postings": ("path", "term", "bucket")}.items():
        assert same(store.table(name, t).select(*columns), full.store.table(whole, t).select(*columns)), t
    streamed = Engine(spark, files, top)
    assert streamed.query("term5x7 term5x8").data["findings"] == full.query("term5x7 term5x8").data["findings"] != []
    # pruning keeps what the newest generation lies on
    assert set(store.layers(name)) <= set(store.names())


def test_many_layers_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cartulary.plans.store.MOST_LAYERS", 2)
    source, top = tmp_path / "in", str(tmp_path / "store")
    for i in range(4):
        spark.createDataFrame([(f"f{i}.md", f"# F{i}\nwords{i}"), ("same.md", f"# S\nversion{i}")], "path string, text string").write.mode("append").parquet(str(source))
        follow(spark, str(source), top, str(tmp_path / "cp")).awaitTermination(120)
    store = Generations(spark, top)
    name = store.open()[0]
    assert len(store.layers(name)) == 2 and store.table(name, "cards").count() == 5
    assert postings.of_terms(store.table(name, "postings"), postings.wanted(spark, "version3 version1")).count() == 1


def made(text, log=None, fails_at=None, usd=0.0):
    """A provider's factory: each call is a line of ``log``; one of them once kills its task."""

    class Writer:
        most_usd = None

        def answer(self, system, user, max_tokens):
            if log:
                with open(log, "a") as f:
                    f.write(user.split("\n")[0] + "\n")
                if fails_at and not os.path.exists(f"{log}.failed") and len(open(log).readlines()) == fails_at:
                    open(f"{log}.failed", "w").close()
                    raise RuntimeError("lost")
            return provider.Answer(text, int(usd / fixed.USD_IN * 1e6), 1)

    return Writer


def test_answers_are_paid_for_once_although_a_build_fails(spark, tmp_path):
    texts = {f"f{i}.md": f"# F{i}\nsome words" for i in range(12)}
    files = lambda: corpus.walk(spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path"))))
    engine, log = Engine(spark, files, str(tmp_path / "store")), str(tmp_path / "log")
    factory = made(json.dumps({"role": "told"}), log, fails_at=9)
    with pytest.raises(Exception, match="lost"):
        engine.index(factory=factory)
    assert not engine.store.names("work") and engine.store.open() is None
    got = engine.index(factory=factory)
    calls = Counter(open(log).read().split("\n")[:-1])
    # the call that was lost before its answer is asked again, nothing else
    assert sorted(calls.values()) == [1] * 11 + [2] and got.spend["calls"] == 12
    assert engine.store.table(engine.store.open()[0], "cards").where("role.value = 'told'").count() == 12
    assert not engine.store.exists(engine.answers_at("cards\n"))


def test_one_cap_holds_for_all_tasks_together(spark, tmp_path):
    texts = {f"f{i:02}.md": f"# F{i}\nthe cache expires entries {i}" for i in range(12)}
    files = lambda: corpus.walk(spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path"))))
    engine, log = Engine(spark, files, str(tmp_path / "store")), str(tmp_path / "log")
    engine.index()
    # a call costs 0.02, more than twice its estimate: 0.055 is passed in the second wave of two
    got = engine.query("cache entries", made("[]", log, usd=0.02), max_usd=0.055, wave=2)
    assert len(open(log).readlines()) == 4 and abs(got.spend["usd"] - 0.08) < 1e-3
    refused = [d for d in got.data["dropped"] if d["reason"] == "budget_hit_before_chunk"]
    assert len(refused) == 8 and got.state == "partial"
    assert engine.query("cache entries", made("[]"), max_usd=0.001, wave=2).spend["calls"] == 0


def test_an_index_leaves_for_later_what_the_cap_has_no_room_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cartulary.plans.engine.WAVE_FILES", 2)
    texts = {f"f{i:02}.md": f"# F{i}\nwords" for i in range(12)}
    files = lambda: corpus.walk(spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path"))))
    engine = Engine(spark, files, str(tmp_path / "store"))
    got = engine.index(0.05, made(json.dumps({"role": "told"}), usd=0.02))
    left = 12 - got.data["cards"]
    assert got.state == "partial" and 0 < left < 12 and got.spend["usd"] < 0.05 + 0.02 * 12 / 2
    assert engine.store.table(got.data["generation"], "skipped").where("reason = 'budget_hit'").count() == left
    assert engine.index(factory=made(json.dumps({"role": "told"}))).data == {"files_to_card": left, "estimated_usd": pytest.approx(0.0025 * left, abs=0.01), "generation": engine.store.open()[0], "cards": 12}


def test_a_brief_within_its_budget_is_the_beginning_of_the_whole(spark, tmp_path):
    texts = {f"d{i % 9}/f{i:03}.md": f"# Heading {i}\n" + "".join(f"## part {j}\n" for j in range(i % 4)) for i in range(120)}
    files = lambda: corpus.walk(spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("adapter", corpus.paths.adapter(F.col("path"))))
    engine = Engine(spark, files, str(tmp_path / "store"))
    engine.index()
    whole = engine.brief().data
    assert list(whole["module_map"]) == sorted(whole["module_map"]) and sum(map(len, whole["module_map"].values())) == 120
    for budget in (50, 500, 3000):
        got = engine.brief(budget).data
        assert got == {"truncated": True, "preview": json.dumps(whole)[: 4 * budget]}
        assert cards.map_within(engine.store.table(whole["generation"], "cards"), 4 * budget).count() <= 4 * budget // cards.LEAST_ENTRY + 1
    assert engine.brief(1_000_000).data == whole
