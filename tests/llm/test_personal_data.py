"""Personal data: base spans against Python's regular expressions, learnt ones against a plain graph."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import personal_data, queries

KINDS = ["email", "ip", "card", "phone"]
FIXED = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text):
    out = []
    for rank, regex in enumerate(FIXED):
        for m in re.finditer(regex, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if rank == 1 and any(int(x) > 255 for x in m[0].split(".")) or rank == 2 and not (12 <= len(number) <= 19 and luhn(number)) or rank == 3 and not 9 <= len(number) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in sorted(out))


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, key string, base string")
    rows = personal_data.find(spark, df).select("doc_id", *[personal_data.told(F.col(c)).alias(c) for c in ("base", "spans")]).collect()
    return {r["doc_id"]: (r["base"], r["spans"]) for r in rows}


def test_query_base_columns(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want.split(",")) for k in KINDS]
        assert {*filter(None, want.split(","))} <= {*r["spans"].split(",")}


ODD = [
    None, "", "a@b", "a@b.c", "a@b.c_d@e.f", "x.@y.z.", "a@b@c.d", "a@b.c.@d.e", "%%%a@b-.c--", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.0.0.1", "1.2.3", "9.9.9.9.9",
    "4111 1111 1111 1111", "4111-1111-1111-1111 0", "4111 1111 1111 1112", "+1 (017) 555-7713", "+1 (017) 555-7713 4111111111111111", "+12", "+1 2", "++491234567890)", "+1 555 (", "é +1 234 567 8901 ü a@b.cd",
    "12 34 56 78 90 12 3", "+4111111111111111", "\u0001a@b.c\n1.1.1.1", "𝒳𝒳 a@b.c 𝒳 8.8.8.8",
]


def test_odd_texts(spark):
    got = found(spark, ODD)
    assert {i: b for i, (b, _) in got.items()} == {i: base(t) for i, t in enumerate(ODD)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aZ09.@+- ()_%é:1", max_size=60), min_size=40, max_size=40))
def test_drawn_texts(spark, texts):
    assert {i: b for i, (b, _) in found(spark, texts).items()} == {i: base(t) for i, t in enumerate(texts)}


def test_very_long_texts_take_time_in_proportion(spark):
    texts = ["a" * 400_000, "1" * 400_000, "a.b" * 100_000 + "@", "x@" + "a." * 150_000, "+1" + " " * 300_000, "1." * 150_000, "8.8.8.8 " * 3000, "1:2:" * 50_000]
    got = found(spark, texts)
    assert got[6][0] == ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(3000)) and got[3][0] == f"email:0:{2 + 299_999}" and got[5][0].count("ip") == 37_500


def test_contexts_discover_identifiers(spark):
    texts = [f"Please call us on +1 (017) 555-77{i}{i} today" for i in range(4)] + [f"write an e-mail to user{i}@mail.example.com now" for i in range(4)]
    texts += ["Please call us on (030) 1234567 today", "Please  CALL us\non 030.7654.321", "page 1234567 of a book", "we paid 1234567 for us", "write an e-mail to root@localhost please", "and to me[at]host.tld", "write an e-mail to me[at]host.tld"]
    # a pattern that an ordinary number follows more often than a telephone
    texts += [f"order number: +1 (017) 555-66{i}{i}" for i in range(3)] + [f"order number: 88{i}{i}7{i}1" for i in range(5)]
    got = found(spark, texts + [texts[8]] * 3)
    more = {i: s for i, (b, s) in got.items() if s != b}
    span = lambda i, kind, value: f"{kind}:{texts[i].index(value)}:{texts[i].index(value) + len(value)}"
    want = {8: span(8, "phone", "(030) 1234567"), 9: span(9, "phone", "030.7654.321"), 12: span(12, "email", "root@localhost"), 13: span(13, "email", "me[at]host.tld"), 14: span(14, "email", "me[at]host.tld")}
    want |= {len(texts) + k: want[8] for k in range(3)}
    # known by its digits: the same number elsewhere
    assert more == want


def test_discovered_identifiers_teach_new_patterns(spark):
    """Three numbers found by a first pattern make a second one, which finds a fourth."""
    first = [f"Please call us on +1 (017) 555-77{i}{i}" for i in range(9)] + [f"Please call us on 030 555 10{i}{i}" for i in range(3)]
    second = [f"my own desk 030 555 10{i}{i}" for i in range(3)] + [f"my own desk +1 (017) 555-88{i}{i}" for i in range(2)]
    third = ["my own desk 030 999 7777"]
    got = found(spark, first + second + third)
    n = len(first + second)
    assert got[n] == ("", "phone:12:24")
    assert found(spark, first + third)[len(first)] == ("", "")


def test_empty_table(spark):
    assert personal_data.find(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
