import numpy as np

from cartulary.llm import embedding_dedup as E
from cartulary.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, least=0.9):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    return n @ n.T >= least


def vectors(seed, n=400, d=64):
    """Clusters whose members lie at cosines from 0.88 to 0.999 of each other, and others."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n // 2, 4):
        for j in range(1, 4):
            x[i + j] = x[i] + rng.standard_normal(d) * rng.uniform(0.05, 0.5)
    return x.astype(np.float32)


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], SCHEMA)
    return {r["vec_id"]: r for r in E.linked_vectors(spark, df).collect()}


def test_codes_are_balanced_and_preserve_neighbours():
    x = vectors(1, 2000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean, projections = E.fit(u)
    bits = (u - mean) @ projections[0] >= 0
    assert 0.3 < bits.mean(axis=0).min() and bits.mean(axis=0).max() < 0.7
    near = (bits[0::4][:200] != bits[1::4][:200]).sum(axis=1).mean()
    far = (bits[1000:1200] != bits[1200:1400]).sum(axis=1).mean()
    assert near < 12 < 25 < far


def test_recall_and_precision_against_brute_force(spark):
    x = vectors(2)
    want = brute(x.astype(np.float64))
    got = run(spark, list(enumerate(x)))
    true = int(np.triu(want, 1).sum())
    found = sum(r["n_links"] for r in got.values()) // 2
    assert found <= true and found >= 0.9 * true
    for i, r in got.items():
        assert r["n_links"] <= want[i].sum() - 1


def test_copies_and_unusable_vectors(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [-1.0, 2.0, -3.0, 1.0]
    rows = [(7, a), (3, a), (9, [2 * v for v in a]), (5, b), (4, None), (6, [0.0] * 4), (8, [1.0, None, 1.0, 1.0]), (2, [float("nan"), 1.0, 1.0, 1.0]), (1, [float("inf"), 1.0, 1.0, 1.0]), (10, a)]
    got = {i: (r["n_links"], r["component_id"]) for i, r in run(spark, rows).items()}
    assert got == {7: (3, 3), 3: (3, 3), 9: (3, 3), 10: (3, 3), 5: (0, 5), 4: (0, 4), 6: (0, 6), 8: (0, 8), 2: (0, 2), 1: (0, 1)}
    assert run(spark, []) == {} and run(spark, [(1, None)])[1]["n_links"] == 0


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute(np.array([r["embedding"] for r in rows], np.float64))
    got = {r["vec_id"]: r for r in QUERIES["op10_embedding_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * (want.sum() - len(rows))
    for i, r in enumerate(rows):
        g = got[r["vec_id"]]
        assert g["n_links"] <= want[i].sum() - 1 and g["kept"] == (g["component_id"] == g["vec_id"])


def test_recall_with_a_large_common_mean(spark):
    """Pairs at cosines just over the bound among vectors at cosine 0.5 or 0.7 of each other."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for common in (0.5, 0.7):
        rng = np.random.default_rng(4)
        a = unit(unit(rng.standard_normal(64)) * np.sqrt(common) + unit(rng.standard_normal((300, 64))) * np.sqrt(1 - common))
        t = rng.standard_normal(a.shape)
        t = unit(t - (t * a).sum(axis=1, keepdims=True) * a)
        x = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * t]).astype(np.float32)
        true = int(np.triu(brute(x.astype(np.float64)), 1).sum())
        found = sum(r["n_links"] for r in run(spark, list(enumerate(x))).values()) // 2
        assert true >= 300 and true >= found >= 0.95 * true, (common, found, true)


def test_just_linked_pairs_with_short_and_long_keys(spark, monkeypatch):
    """Recall of pairs at cosines from 0.90 to 0.92 alone, as for few vectors and for a million."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rng = np.random.default_rng(6)
    for d in (64,):
        a = unit(rng.standard_normal((500, d)))
        t = rng.standard_normal(a.shape)
        t = unit(t - (t * a).sum(axis=1, keepdims=True) * a)
        cos = rng.uniform(0.9005, 0.92, (500, 1))
        x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * t]).astype(np.float32)
        want = brute(x.astype(np.float64))
        for keys in ((16, 32), (20, 32)):
            monkeypatch.setattr(E, "KEYS", keys)
            got = run(spark, list(enumerate(x)))
            hit = [got[i]["component_id"] == got[i + 500]["component_id"] for i in range(500) if want[i, i + 500]]
            assert len(hit) > 450 and sum(hit) >= 0.9 * len(hit), (d, keys, sum(hit), len(hit))


def test_candidates_a_vector_do_not_grow_with_the_table():
    apart = E.opening(np.eye(4), np.zeros(4), 0.9)
    """Rows that a vector meets in buckets, were all codes spread evenly."""
    met = []
    for n in (65_536, 1 << 20, 1 << 24, 1 << 30):
        bits, codes = E.tables_for(n, apart)
        met.append(codes * (E.BITS // bits) * (1 + bits / 2) * n / 2**bits)
    assert all(m < 1100 for m in met) and met[-1] / met[0] < 20
    assert E.tables_for(50_000, apart) == (16, 2)


def test_vectors_of_another_length_and_ties(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 0.0]), (5, [0.9, (1 - 0.81) ** 0.5])]
    got = {i: (r["n_links"], r["component_id"]) for i, r in run(spark, rows).items()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1 if brute(np.array([rows[3][1], rows[4][1]], np.float32).astype(np.float64))[0, 1] else 0, 4), 5: (got[4][0], 4 if got[4][0] else 5)}


def test_common_means_cost_no_recall_and_few_strangers(spark):
    """Vectors at a common cosine of 0, 0.5 or 0.7, and pairs of them just linked."""
    for common in (0.0, 0.5, 0.7):
        rng = np.random.default_rng(int(common * 10))
        d, n = 64, 1600
        top = np.eye(d)[0]
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        own = unit(rng.standard_normal((n, d - 1)))
        x = np.sqrt(common) * top + np.sqrt(1 - common) * np.concatenate([np.zeros((n, 1)), own], axis=1)
        y = unit(x[:400] + 0.44 * unit(rng.standard_normal((400, d))))
        rows = np.concatenate([x, y]).astype(np.float32).astype(np.float64)
        u = unit(rows)
        want = np.triu(u @ u.T >= 0.9, 1)
        assert want.sum() > 200
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
        got = E.linked_vectors(spark, df).selectExpr("sum(n_links)").first()[0] // 2
        assert 0.9 * want.sum() <= got <= want.sum(), common
        origin, projections, bits, near = E.index_for(u, len(u), 0.9)
        classes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(u)], "cid long, v array<double>")
        classes = classes.select("cid", E.coder(origin, projections)(classes["v"]).alias("codes"))
        met = E.candidates(classes, bits, len(projections), near).count()
        assert met - want.sum() < 0.05 * len(u) * (len(u) - 1) / 2, (common, met)
