"""Queries over texts of more headings than a card keeps, or with odd ends, give their SQL's rows."""

import duckdb
import pytest
from conftest import plain

from cartulary.functions import skeleton
from cartulary.plans.catalogue import QUERIES
from cartulary.plans.oracles import ORACLES

TEXTS = {
    15: "\n".join(f"line {i}" for i in range(1, 1_204)),  # prose, 240 headings
    12: "\n".join(f"line {i}" for i in range(1, 1_204)),  # code
    16: "a\n\n", 17: "\n\n\n\n\n", 18: "", 19: "1\n2\n3\n4\n\n\n", 25: "1\n2\n3\n4\nfive\rin two", 26: "1\n2\n3\n4\n5\n",
}


@pytest.mark.parametrize("name", ["outline", "chunks_boundary"])
def test_query_equals_its_sql_on_long_texts(spark, tmp_path, name):
    rows = [(i, text, "en", "web") for i, text in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(columns, want.fetchall())


def test_cards_still_keep_their_number_of_headings(spark):
    df = spark.createDataFrame([("\n".join(["# h"] * 300),)], "text string")
    kept, all_ = df.select(skeleton.outline(df.text), skeleton.outline(df.text, None)).first()
    assert (len(kept), len(all_)) == (skeleton.MOST, 300)
