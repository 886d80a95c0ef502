"""Redaction against its plain form, on whole tables, small cases and drawn texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_redaction import redact_text
from pyspark.sql import functions as F

from cartulary.functions.redact import redact

HEX = "0123456789abcdef0123456789abcdef01234567"
CASES = [
    "mail a@b.io, api_key = 'abcdef123' and /home/joe/x; Bearer abcdefghijkl123 then a@b.io",
    f"token = {HEX}", "key: 123e4567-e89b-12d3-a456-426614174000", "see a/b/c/" + "x" * 40, "secret =   ", "password: [REDACTED_SECRET_1 len=3]",
    "AKIA" + "A1B2C3D4E5F6", "ghp_abcdefgh12", "eyJabc.def.ghi", "--token s3cr3t", '{"password": "hunter2"}', "secret: hunter2",
    "a = ghp_abcdefgh12 and ghp_abcdefgh12 and ghp_other12345", "Bearer ghp_abcdefgh12\nBearer  abcdefghijklmno==\nbearer abcdefghijklmnop",
    "x_token=one&y_token=one&z_Key='two'", "'my api': \"v1\" 'auth' : 'v2'", '"k": 1, "apikey": "v, w"', "--my-auth  --other", "  password : a b c, d", "ſecret = long", "\u212aey: kelvin",
    "Abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF", "abcdefghijklmnopqrstuvwxyzabcdefgh", "a/b/cdefghijklmnopqrstuvwxyz0123456789", "Aa1" * 11,
    "é key=ü $1 \\2 \\E $0", "mixed me@x.de, you@x.de, me@x.de é@x.de", "", " ", "/Users/a.b/c /home/x/ /home/x", "api: a\rtoken: b\u2028key: c\nauth: d", "-----BEGIN KEY-----\n" + "Qx9" * 30 + "\n",
]


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", redact(F.col("t")).alias("r")).collect()
    got = {r["i"]: (r["r"]["text"], r["r"]["count"]) for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == redact_text(t), t


def test_small_cases(spark):
    check(spark, CASES)


def test_what_the_contract_asks():
    text, n = redact_text(CASES[0])
    assert n == 4 and "~/x" in text and "abcdef123" not in text and "a@b.io" not in text
    assert "Bearer [REDACTED_SECRET_1 len=15]" in text and "[REDACTED_SECRET_2 len=9]" in text and text.count("[REDACTED_EMAIL_3]") == 2
    assert all(redact_text(t) == (t, 0) for t in CASES[1:6]) and all(redact_text(t)[1] == 1 for t in CASES[6:12])


@pytest.mark.parametrize("table, column", [("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")])
def test_whole_tables(spark, sf, table, column):
    rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(column).alias("t")).select("t", redact(F.col("t")).alias("r")).collect()
    assert all((r["r"]["text"], r["r"]["count"]) == redact_text(r["t"]) for r in rows if r["t"] is not None)


PARTS = st.sampled_from(["key", "Token", "api", "=", ": ", '"', "'", " ", "\n", "--", "Bearer ", "sk-", "ghp_", "abcdefgh1234", "AKIA", "Zz9", "@", ".com", "x", "é", "/home/u/", "/", HEX, "eyJ", ".", ",", "#"])


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=150, max_size=150))
def test_drawn_texts(spark, texts):
    check(spark, texts)
