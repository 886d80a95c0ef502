"""Behaviour of text, path and redaction functions on small cases."""

from pyspark.sql import functions as F

from cartulary.functions import paths, skeleton, text
from cartulary.functions.redact import redact


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_are_stemmed_distinct_and_ordered(spark):
    assert one(spark, text.terms(F.lit("The Caches caching of cached S3_KEY and boxes, bus"))) == ["cach", "s3_key", "box", "bus"]
    assert one(spark, text.terms(F.lit("a an it"))) == []


def test_stem_keeps_three_letters(spark):
    rows = spark.createDataFrame([(w,) for w in ("sing", "singing", "used", "uses", "ass", "does")], "w string")
    assert [r[0] for r in rows.select(text.stem(F.col("w"))).collect()] == ["sing", "sing", "used", "use", "ass", "doe"]


def test_lines_drop_only_the_last_break(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb": ["a", "b"], "\n\n": ["", ""], "a\n\nb\n": ["a", "", "b"]}
    for given, want in cases.items():
        assert one(spark, text.lines(F.lit(given))) == want, given


def test_null_texts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.terms(null)) is None
    assert one(spark, text.lines(null)) is None


def test_jsonish(spark):
    assert one(spark, text.jsonish(F.lit('```json\n[1]\n```'))) == "[1]"
    assert one(spark, text.jsonish(F.lit("  [1]\x01 "))) == "[1]"


def test_outline_and_symbols(spark):
    doc = "# A\nx\n####### no\n  ## B  \n#c"
    found = one(spark, skeleton.outline(F.lit(doc)))
    assert [(h["text"], h["line"], h["level"]) for h in found] == [("A", 1, 1), ("B", 4, 2)]
    code = "pub async fn go()\nlet fn_x = 1\n  class Card:"
    assert [(s["name"], s["kind"], s["line"]) for s in one(spark, skeleton.symbols(F.lit(code), F.lit("code")))] == [("go", "pub", 1), ("Card", "class", 3)]


def test_roles(spark):
    role = lambda p, t: one(spark, skeleton.role(F.lit(p), F.lit(t)))
    assert role("x/AGENTS.md", "# A") == "agent working agreements and repo instructions"
    assert role("README.md", "") == "project overview and usage documentation"
    assert role("a.md", "x\n# Title") == "Title"
    assert role("a.rs", "fn go()") == "defines go and related fn code"
    assert role("a.rs", "x") == "code file"


def test_extension_and_adapter(spark):
    got = {p: one(spark, paths.adapter(F.lit(p))) for p in ("a.MD", "a.b/c", ".txt", "x.pdf", "x.docx", "x.rs", "a.rst")}
    assert got == {"a.MD": "markdown", "a.b/c": "code", ".txt": "code", "x.pdf": "pdf", "x.docx": "docx", "x.rs": "code", "a.rst": "markdown"}


def test_redact_column(spark):
    rows = spark.createDataFrame([(1, "x a@b.io"), (2, None), (3, "")], "id int, t string").select("id", redact(F.col("t")).alias("r")).orderBy("id").collect()
    assert [(r["r"]["text"], r["r"]["count"]) for r in rows] == [("x [REDACTED_EMAIL_1]", 1), (None, 0), ("", 0)]


def test_running_sums(spark):
    for n in (0, 1, 2, 511, 512, 513, 1500):
        got = spark.range(1).select(text.running_sums(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: (x * 7 % 11).cast("int"))).alias("x")).first()["x"]
        want, total = [], 0
        for x in range(n + 1):
            total += x * 7 % 11
            want.append(total)
        assert got == want
    assert spark.range(1).select(text.running_sums(F.array().cast("array<int>"))).first()[0] == []
