import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cartulary.llm import simhash_dedup as S
from cartulary.llm.common import Saved
from cartulary.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(nodes, edges):
    least = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def brute_components(values, radius):
    edges = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    return reach(values, edges)


def near_values(rnd, n, centres=5):
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(n // centres):
            v = c
            for _ in range(rnd.randrange(6)):
                v ^= 1 << rnd.randrange(64)
            out.add(v - (1 << 64) if v >> 63 else v)
    return sorted(out)


def test_fingerprint_equals_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", None, "a", "A  b", "a b\tc", "é ü ß É", "x " * 500] + [" ".join(rnd.choice("ab cd éf Gh".split()) for _ in range(rnd.randrange(40))) for _ in range(60)]
    for t in texts:
        assert S.fingerprint(t) & (2**64 - 1) == brute_fingerprint(t), t
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_bk_tree_finds_every_link():
    rnd = random.Random(2)
    for radius in (0, 1, 2, 5):
        values = near_values(rnd, 80)
        links = S.spanning(np.array(values, np.int64), radius)
        assert reach(values, links) == brute_components(values, radius)


def test_links_equal_brute_force_with_split_shards(spark):
    values = near_values(random.Random(3), 160, 3)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    saved = Saved(spark)
    for tree in (8192, 4):
        edges = [(r["u"], r["v"]) for r in S.links(spark, df, 2, saved, tree).collect()]
        assert reach(values, edges) == brute_components(values, 2)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(spark, df).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[301] == 300 and 200 not in got
    assert components(spark, df.limit(0)).count() == 0


def docs():
    base = " ".join(f"w{i}" for i in range(60))
    return [(9, base), (3, base), (None, base), (5, base.upper()), (7, ""), (8, None), (2, "quite other words in here"), (2, "quite other words in here")]


def test_rows_keep_their_class(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in S.near_duplicates(spark, spark.createDataFrame(docs(), SCHEMA)).collect() if r["doc_id"] is not None)
    assert [(d, c) for _, d, c in got] == [(2, 2), (2, 2), (3, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    assert S.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays_with_its_columns(spark):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(docs())], SCHEMA + ", _fp int, root string")
    got = S.one_of_each(spark, df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3, 7]
    assert S.one_of_each(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(prints)
    want = reach(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
    from cartulary.llm.queries import QUERIES

    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op6_simhash_dedup"](spark, sf).collect()}
    assert got == {i: (prints[i], want[i]) for i in ids}


def test_saved_tables_are_swept(spark):
    from cartulary.llm.common import shared_folder, sweep
    from cartulary.plans.store import Store

    saved = Saved(spark)
    saved.write(spark.range(3))
    store = Store(spark, shared_folder(spark))
    assert any(n.startswith("cartulary-") for n in store.names())
    sweep(spark)
    assert not any(n.startswith("cartulary-") for n in store.names())


def test_one_of_each_with_columns_named_like_inner_ones(spark):
    names = ["n", "id", "fp", "root", "best", "_row", "_fp", "_at"]
    df = spark.createDataFrame([(i, t, *[7] * len(names)) for i, t in ((1, "a b c d"), (2, "a b c d"), (3, "other words"))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = S.one_of_each(spark, df)
    assert out.columns == df.columns and {(r["doc_id"], r["n"], r["_at"]) for r in out.collect()} == {(1, 7, 7), (3, 7, 7)}
