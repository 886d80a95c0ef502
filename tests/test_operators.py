"""Chunks, the firewall, packing and evaluation against plain models."""

import random

from pyspark.sql import functions as F

from cartulary.operators import chunk, evalkit, firewall, report, route


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, adapter string")


def test_chunk_modes(spark):
    text = "\n".join(["# A" if i in (3, 7) else f"l{i}" for i in range(1, 13)])
    spans = lambda mode, w, o=0: sorted((r["first_line"], r["last_line"]) for r in chunk.chunks(files(spark, [("a.md", text, "markdown")]), mode, w, o).collect())
    assert spans("fixed", 5) == [(1, 5), (6, 10), (11, 12)]
    assert spans("boundary", 3) == [(1, 2), (3, 5), (7, 9)]
    assert spans("boundary_overlap", 3, 2) == [(1, 4), (3, 7), (7, 11)]
    assert spans("boundary_split", 3) == [(1, 2), (3, 5), (6, 6), (7, 9), (10, 12)]
    assert chunk.chunks(files(spark, [("a.md", "", "markdown")]), "fixed", 5).count() == 0


def test_rank_keeps_the_best_of_each_file(spark):
    rnd = random.Random(5)
    rows = [(f"f{rnd.randrange(6)}", i, " ".join(rnd.choice(["alpha", "beta", "x", "y"]) for _ in range(6)), rnd.choice([0.0, 0.5]), None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, first_line int, body string, score double, router_rank int, look_for string")
    score = {(p, i): s + sum(2 + b.count(t) for t in ("alpha", "beta") if t in b) for p, i, b, s, _, _ in rows}
    best = {p: min(((-score[k], k[1], k) for k in score if k[0] == p))[2] for p in {r[0] for r in rows}}
    order = sorted(score, key=lambda k: (k not in best.values(), -score[k], k[0], k[1]))
    got = {(r["path"], r["first_line"]) for r in chunk.rank_chunks(df, "alpha beta", 12).collect()}
    assert got == set(order[:12])


def test_candidates_count_inverse_frequency(spark):
    sets = spark.createDataFrame([("a", ["red", "blue"]), ("b", ["red"]), ("c", ["green"]), ("red blue.md", [])], "path string, terms array<string>")
    got = [(r["path"], r["score"]) for r in route.candidates(spark, sets, "red blue").collect()]
    assert got == [("red blue.md", 2.0), ("a", 1.5), ("b", 0.5)]
    assert route.candidates(spark, sets, "of the").count() == 0


def test_merge_loses_no_candidate(spark):
    router = spark.createDataFrame([("a", 0, ""), ("z", 2, "hint"), ("a", 5, "x")], "path string, router_rank int, look_for string")
    det = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "path string, score double")
    got = {r["path"]: (r["router_rank"], r["score"], r["look_for"]) for r in route.merge(router, det).collect()}
    assert got == {"a": (5, 0.5, "x"), "b": (None, 0.1, None), "z": (2, 0.0, "hint")}


def test_firewall_verdicts(spark):
    text = "one two\n\nthree   four\n*bold* words\nfive\n" + "\n".join(f"n{i}" for i in range(20))
    docs = files(spark, [("a.md", text, "markdown"), ("a.rs", text, "code")])
    cases = [
        ("a.md", 3, "f", "three four", "exact"), ("a.md", 8, "f", "three four", "exact"), ("a.md", 9, "f", "three four", "line_mismatch:3"),
        ("a.md", 1, "f", "two three", "quote_not_in_file"), ("a.md", 4, "f", "bold words", "markdown_normalized"), ("a.rs", 4, "f", "bold words", "quote_not_in_file"),
        ("a.md", 20, "f", "bold words", "line_mismatch:4"), ("b.md", 1, "f", "x", "file_missing"), ("a.md", 1, "f", " ", "empty"), ("a.md", 1, None, "five", "empty"), ("a.md", 1, "f", None, "empty"),
        ("a.md", 4, "f", "words five", "exact"),
    ]
    df = spark.createDataFrame(cases, "path string, line int, fact string, quote string, want string")
    for r in firewall.verify(df, docs).collect():
        assert r["verdict"] == r["want"], r


def test_pack_charges_reduced_rows(spark):
    rnd = random.Random(3)
    items = [(i, rnd.randrange(1, 60), rnd.randrange(1, 10)) for i in range(30)]
    used, want = 200, []
    for _, full, reduced in items:
        fits = used + full <= 500
        used += full if fits else reduced
        want.append(not fits)
    df = spark.createDataFrame([(items,)], "items array<struct<i:int,full:int,reduced:int>>")
    assert df.select(report.pack(F.col("items"), "full", "reduced", 500).alias("o")).first()["o"] == want


def test_admission_is_sticky(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.7), (3, 0.1)], "i int, cost double")
    assert [r["admitted"] for r in chunk.admitted(df, "cost", 1.0, ["i"]).orderBy("i").collect()] == [True, False, False]


def test_index_states(spark):
    none = F.array().cast("array<string>")
    state = lambda n, s, u=none: spark.range(1).select(report.index_state(F.lit(n), s, u)).first()[0]
    failed = F.array(F.lit("provider_error: x"))
    assert state(0, failed) == "provider_error" and state(2, failed) == "partial"
    assert state(0, F.array(F.lit("budget_hit"))) == "budget_hit" and state(1, none) == "ok"
    assert state(1, none, F.array(F.lit("unsupported_or_tool_missing"))) == "tool_degraded"


def test_poison_needs_its_subject(spark):
    says = lambda p, q, f: spark.range(1).select(evalkit.asserts(F.lit(p), F.lit(q), F.lit(f))).first()[0]
    assert says("Redis stores sessions", "where are sessions", "Redis stores all sessions")
    assert not says("Redis stores sessions", "where are sessions", "Postgres stores sessions")
    assert not says("Redis stores sessions", "where are sessions", "Redis does not store sessions")
    assert not says("Only Redis stores sessions", "where", "Redis stores sessions")
    assert says("Only Redis stores sessions", "where", "Only Redis stores sessions")


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0, False, 1, 0.1, True), (0, 0, 0, 0, 0, True, 2, 0.1, True)], "recall_found int, recall_total int, covered int, facts int, poison int, negative boolean, findings int, usd double, complete boolean")
    got = evalkit.gates(df).first()
    assert got["recall_pct"] == 100 and not got["negatives_clean"] and not got["green"]
