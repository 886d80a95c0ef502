import re

import pytest

from cartulary.llm import license_scan as L
from cartulary.llm.license_rules import ANCHORS, BASE, CC_BY, rules, signatures
from cartulary.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Base places and surviving labels by words, without any gate."""
    words = words_of(text)
    base = sorted(i for _, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    own = {label for label, p in BASE if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
    norm = " " + " ".join(words) + " "
    found = []
    for r in rules():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + len(m[0].split()), r.priority, r.label, r.score))
    order = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3], d[4]))
    left = [d for i, d in enumerate(order) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in order[:i])]
    score = max([d[4] for d in left] + [0.9] * bool(own) + [0.0])
    return len(words), base, sorted(own), sorted(own | {d[3] for d in left}), score


TEXTS = [
    None, "", "nothing here", "MIT License. MIT-license, (mit) license", "Licensed under the Apache License, Version 2.0 or later.", "CC BY-NC-SA 4.0 and cc-by 3.0; CC/BY",
    "GNU General Public License version 3 or (at your option) any later version", "gnu lesser general public license v2.1 only", "mitlicense mit licensee admit license",
    "All rights reserved. Copyright (c) 2019 X", "apache license apache license 2.0", "the GNU\nGENERAL\tpublic LICENSE", "École é mit license ñ", "version 2 0 of the gnu general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "x " * 3000 + "mit license " * 200, "cc by" , "İ mit license K",
]


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    return {r["doc_id"]: r for r in L.scan(df).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_equals_brute_force(scanned, i):
    r = scanned[i]
    assert (r["n_words"], r["base"], r["base_labels"], r["labels"], pytest.approx(r["score"])) == brute(TEXTS[i])


def test_there_are_hundreds_of_rules_and_gates_lose_none():
    found = rules()
    assert len(found) >= 300 and len({r.pattern for r in found}) == len(found)
    cc_by = re.compile(CC_BY.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    assert len(signatures()) >= 180
    for r in found:
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)\?", "", r.pattern)
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)", r"\1", plain).replace(" ?", " ").replace("[cs]", "s").replace("[0-9][0-9]", "20")
        assert re.fullmatch(r.pattern, plain), (r, plain)
        assert f" {r.keyword} " in f" {plain} " and (any(a in plain for a in ANCHORS) or cc_by.search(plain)), (r, plain)


def test_rows_stay_rows_and_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "mit license", 5), (1, "mit license", 5), (None, None, 6)], SCHEMA + ", score int")
    got = L.scan(df)
    assert got.count() == 3 and dict(got.dtypes)["score"] == "double"
    assert L.scan(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, sf).collect()}
    assert len(got) == len(rows)
    for row in rows:
        n, base, own, labels, score = brute(row["text"])
        r = got[row["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), base[0] if base else None, base[-1] if base else None)
        assert (r["base_labels"], r["labels"]) == (",".join(own), ",".join(labels)) and abs(r["score"] - score) < 1e-9
