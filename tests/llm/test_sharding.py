import zlib
from collections import Counter

from cartulary.llm import sharding as S
from cartulary.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, shard int"


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_groups_stay_together_under_the_law(spark):
    rows = [(i, f"t{i // 3}", 0) for i in range(300)] + [(1000 + i, f"single {i}", 0) for i in range(101)]
    got = S.shard_documents(spark, spark.createDataFrame(rows, SCHEMA), 8).collect()
    check(got, 8)
    text = {r[0]: r[1] for r in rows}
    groups = {}
    for r in got:
        groups.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    cut = sum(len(v) - 1 for v in groups.values())
    assert cut <= 8  # of 200 links


def test_a_group_beyond_the_quota_is_split(spark):
    rows = [(i, "same", 0) for i in range(90)] + [(100 + i, f"x{i}", 0) for i in range(30)]
    got = S.shard_documents(spark, spark.createDataFrame(rows, SCHEMA), 4).collect()
    check(got, 4)


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 1), (1, "", 1), (2, "é", 1), (3, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.shard_documents(spark, df, 4).collect()
    check(got, 4)
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes == {None: (16, 0), 1: (16, 0), 2: (18, zlib.crc32("é".encode())), 3: (100_016, zlib.crc32(b"x" * 100_000))}
    assert S.shard_documents(spark, df.limit(0), 4).count() == 0


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    check(rows, 40)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for d, t in texts.items()}
    assert sorted(map(str, QUERIES["op2_sharding"](spark, sf).collect())) == sorted(map(str, rows))
