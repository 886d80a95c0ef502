import glob
import random

import corpus_pipeline
from cartulary.llm import language_id, line_dedup, simhash_dedup, source_mix


def test_stages_pass_whole_documents_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "best_fit"]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, sf)
    assert one.columns == docs.columns and {r[0] for r in one.select("doc_id").collect()} == ids  # all have letters
    two = stages["line_dedup"](spark, one, sf)
    assert two.columns == docs.columns and two.where("n_chars <> length(text)").count() == 0
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, one).collect()}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want
    three = stages["simhash_dedup"](spark, two, sf)
    groups = {r["component_id"] for r in simhash_dedup.near_duplicates(spark, two).collect()}
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == groups
    four = stages["source_mix"](spark, three, sf)
    assert four.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in source_mix.mix(spark, three).collect()}
    got = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}


def test_run_is_the_stages_in_order(spark, sf):
    from cartulary.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    tables = lambda: {p for p in glob.glob(f"{folder}/cartulary-*/*")}
    before = tables()
    out = corpus_pipeline.run(spark, sf)
    assert len(tables() - before) == 1  # the result; what led to it is deleted
    rows = out.collect()
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and rows
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096


def test_rejects_only_what_has_no_language(spark):
    df = spark.createDataFrame([(1, "words here", "en"), (2, "123 !!", "en"), (3, None, "en"), (4, "Ünï", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language_id.accepted(spark, df).collect()} == {1, 4}


def test_keeps_every_text_with_a_letter_without_labels(spark):
    """Ids 0 and 1 are not held out; with and without a label to learn from."""
    for lang in ("en", None):
        df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(["words here", "123 !!", None, "Ünï", "more", ""])], "doc_id long, text string, lang string")
        assert {r["doc_id"] for r in language_id.accepted(spark, df).collect()} == {0, 3, 4}


def test_stages_keep_clashing_columns_and_take_odd_rows(spark, sf):
    extra = ["n", "root", "id", "fp", "row", "lid", "k", "pos", "copies", "size", "at", "best", "key", "target", "n_lines", "score", "n_lines_", "n_removed_", "lang_pred_of_row", "score_of_row", "lang_pred_of_row_score_of_row_", "_lang_pred", "_score", "_found"]
    rows = [(1, "one two three four five six", "a", "en"), (1, "one two three four five six", "a", "en"), (2, "entirely other words stand here now", None, None), (3, None, "b", "en"), (None, "yet another text of several words", "b", "en"), (4, "", "a", "en")]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *[f"{c}!" for c in extra]) for r in rows], schema)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), schema)
        assert now.columns == docs.columns, name
    for r in now.collect():
        assert [r[c] for c in extra] == [f"{c}!" for c in extra]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert pieces.count() >= now.count() > 0


def test_an_empty_table_goes_through(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_line_stage_compares_hot_buckets_in_full(spark, monkeypatch):
    """Pairs that share only the block of a bucket over HOT, and are not drawn by lot."""
    rnd = random.Random(6)
    short = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwxy") for _ in range(3))
    alone = [[short() for _ in range(7)] for _ in range(30)]
    texts = ["extraordinary circumstances " + " ".join(words) for words in alone]
    texts += [t[:28] + " ".join(w[:1] + "z" + w[2:] for w in words) for t, words in zip(texts[:6], alone)]
    for name, value in (("HOT", 4), ("CROWD", 4), ("DRAWS", (1, 1, 1))):
        monkeypatch.setattr(corpus_pipeline.line_dedup, name, value)
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t if i < 30 else "" for i, t in enumerate(texts)}
