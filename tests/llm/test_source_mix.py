import re

import numpy as np
import pytest

from cartulary.llm import source_mix as S
from cartulary.llm.queries import QUERIES


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule's words: stop at the cap, share the excess anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_flight_keeps_both_sums_and_settles_all_but_two():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 2000):
        pi, x = rng.random(n), rng.integers(0, 500, n)
        p = S.flight(pi, x, rng)
        assert ((p > S.EPS) & (p < 1 - S.EPS)).sum() <= 2
        assert abs(p.sum() - pi.sum()) < 1e-6 and abs((p * x).sum() - (pi * x).sum()) < 1e-3


def test_equal_sizes_and_zeros():
    rng = np.random.default_rng(2)
    p = S.landing(np.full(100, 0.3), np.zeros(100), rng)
    assert set(p) <= {0.0, 1.0} and 29 <= p.sum() <= 31


def test_inclusion_is_unbiased():
    total = np.zeros(20)
    pi, x = np.linspace(0.05, 0.95, 20), np.arange(20)
    for seed in range(1500):
        total += S.landing(pi, x, np.random.default_rng(seed))
    assert np.abs(total / 1500 - pi).max() < 0.06


@pytest.fixture
def docs(spark):
    rows = [(i, "w " * (i % 30), f"s{i % 4}") for i in range(1200)] + [(2000 + i, "w " * 50, None) for i in range(40)] + [(None, None, "s9"), (5, "w " * 5, "s1"), (5, "w " * 5, "s1"), (6, "x", "Z")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_mix_meets_targets_and_reruns_agree(spark, docs):
    rows = S.mix(spark, docs).collect()
    again = S.mix(spark, docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sizes, taken, most = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert r["taken"] in {k * r["size"] for k in range(4)}
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s] + 1, s


def test_mixed_repeats_rows(spark, docs):
    got = S.mixed(spark, docs)
    assert got.columns == docs.columns
    per = got.groupBy("source").count().collect()
    plan = {r["source"]: r["n"] for r in S.mix(spark, docs).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert {r["source"]: r["count"] for r in per} == {s: n for s, n in plan.items() if n}


def test_empty(spark, docs):
    assert S.mix(spark, docs.limit(0)).count() == 0 and S.mixed(spark, docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_source_mix"](spark, sf).collect()
    sizes = {}
    for t, s in texts.values():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = brute_targets(sizes)
    for r in rows:
        t, s = texts[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    for s, total in want.items():
        mine = [r for r in rows if texts[r["doc_id"]][1] == s]
        assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in mine)
        assert abs(sum(r["taken"] for r in mine) - total) <= 2 * max((r["size"] for r in mine), default=0) + 1, s


def test_a_very_long_text_counts_whole(spark):
    rows = [(1, "w " * 300_000, "a"), *[(i, "one two three", "b") for i in range(2, 40)]]
    got = {r["doc_id"]: r for r in S.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["size"] == 300_000 and got[1]["taken"] <= 900_000 and got[2]["size"] == 3
