import zlib

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import language_id as L
from cartulary.llm.queries import QUERIES


def samples(n, seed):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["lo", "mi", "ta"], "bb": ["kx", "zq", "wv"], "cc": ["é", "ñu", "ça"]}
    return [("".join(rng.choice(p) + (" " if rng.random() < 0.4 else "") for _ in range(120)), lang) for lang, p in parts.items() for _ in range(n)]


def fitted():
    rows = samples(60, 0)
    langs = ["aa", "bb", "cc"]
    return L.train(np.concatenate([L.windows_of(t)[:1] for t, _ in rows]), np.array([langs.index(x) for _, x in rows]), langs, epochs=4)


def test_network_learns_and_is_the_same_each_time():
    net, again = fitted(), fitted()
    assert (net.filters == again.filters).all()
    rows = samples(30, 9)
    found = list(L.scored(net, [t for t, _ in rows]))
    assert np.mean([f[0] == x for f, (_, x) in zip(found, rows)]) > 0.97 and all(0 <= f[1] <= 1 for f in found)


def test_gradient_is_that_of_the_loss():
    """Steps of training, one an epoch here, lower the loss on their own batch."""
    rows = samples(20, 3)
    langs = ["aa", "bb", "cc"]
    w, y = np.concatenate([L.windows_of(t)[:1] for t, _ in rows]), np.array([langs.index(x) for _, x in rows])
    loss = lambda net: -np.log(net.probabilities(w)[np.arange(len(y)), y] + 1e-9).mean()
    few, more, many = (loss(L.train(w, y, langs, epochs=e)) for e in (1, 8, 40))
    assert many < more < few and many < 0.5 * few


def test_pooling_equals_direct_convolution():
    net, w = fitted(), L.windows_of("lo mi ta kx")[:1]
    x, wide = net.embed[w[0]], max(L.WIDTHS)
    direct = np.array([[x[t : t + wide].reshape(-1) @ net.filters[:, f] for f in range(net.filters.shape[1])] for t in range(L.WINDOW - wide + 1)]).max(axis=0)
    assert np.allclose(net.pooled(w)[2][0], direct + net.bias, atol=1e-4)


def test_all_windows_of_long_texts_count():
    net = fitted()
    a, b = (next(t for t, x in samples(1, 5) if x == lang) for lang in ("aa", "bb"))
    assert next(L.scored(net, [a[:100] + b * 40]))[0] == "bb"


def test_und_nulls_and_clashes(spark):
    rows = [(i, t, x, 0.5) for i, (t, x) in enumerate(samples(40, 2))] + [(1000, None, "aa", 0.1), (1001, "12 ... !", "bb", 0.1), (None, "lo mi", None, 0.1), (1002, "", None, 0.1), (1003, "lo mita lo", None, 0.1), (1003, "lo mita lo", None, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = L.identify(spark, df)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] == "aa"
    kept = L.accepted(spark, df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {1000, 1001, 1002}
    assert L.identify(spark, df.limit(0)).count() == 0
    unknown = L.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unknown] == ["und"]


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_labels_of_held_out_rows_change_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).write.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda where: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in QUERIES["op7_language_id"](spark, where).collect())
    changed = plain(str(tmp_path))
    assert "zz" not in {r[1] for r in changed} and changed == plain(sf)
