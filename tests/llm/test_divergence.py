"""The audit of sources against SQL and against dense loops over whole integers."""

import re
from collections import Counter, defaultdict

import pytest

from cartulary.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(docs):
    words = [(lang or "", source or "", Counter(t.translate(LOW) for t in TERM.findall(text or ""))) for text, lang, source in docs]
    out = set()
    for lang in {w[0] for w in words}:
        df, count = Counter(), defaultdict(Counter)
        for la, source, c in words:
            if la == lang:
                df.update(c.keys())
                count[source].update(c)
        kept = sorted(t for t, n in df.items() if n >= 3)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            over = [(t, apart(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", over, 200)):
                for i, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, v, i + 1))
    return out


def told(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_its_sql(same):
    same(queries.QUERIES["op12_divergence"], queries.ORACLES["op12_divergence"])


DOCS = [
    ("alpha Beta alpha straße_x", "en", "a"), ("ALPHA beta\x7fgamma é é", "en", "b"), ("alpha beta é delta", "en", "c"), ("beta alpha é", "en", "a"),
    (None, "en", "d"), ("", None, None), ("12 34 -- !!", None, "z"), ("solo words only here", "fr", "one"), ("solo", "fr", "one"), ("solo solo", "fr", "two"),
    ("alpha beta é", "en", None), ("alpha beta é", "en", None), ("漢字 alpha 漢字", "en", "b"), ("x" * 200_000 + " alpha", "en", "c"), ("漢字", "en", "c"), ("漢字 " * 5000, "en", "a"),
    *[(" ".join(f"w{i}" for i in range(k, k + 230) for _ in range(i % 4 + 1)), "en", "abc"[k % 3]) for k in range(9)],
]


@pytest.mark.parametrize("automaton", [200_000, 40, 0])
def test_dense_loops_whatever_the_automaton_holds(spark, automaton):
    rows = [(t, la, s, "x", 1) for t, la, s in DOCS]
    df = spark.createDataFrame(rows, "text string, lang string, source string, term string, n int").repartition(3)
    assert told(divergence.audit(spark, df, automaton=automaton)) == dense(DOCS)


def test_small_counters_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["l", "l", "m"], "text": [b"a b c D", b"a b", b"e f"]})
    got = Counter()
    outs = list(divergence.document_frequencies([batch]))
    for out in outs:
        for r in out.to_pylist():
            got[r["term"]] += r["n"]
    assert len(outs) > 1 and got == Counter({b"a": 2, b"b": 2, b"c": 1, b"d": 1, b"e": 1, b"f": 1})


def test_empty_table(spark):
    assert divergence.audit(spark, spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_automaton_finds_neighbours_and_other_words():
    found = divergence.Automaton([b"a", b"ab", "é".encode()])
    hits, others = found.count("a a  abc ab é x é".encode())
    assert hits == [0, 0, 1, 2, 2] and others == [b"abc", b"x"]


def test_listed_terms_cross_to_spark_as_numbers():
    """Their bytes are not handed on for each group; other words are."""
    import pyarrow as pa

    class Listed:
        value = [b"a", b"ab"]

    batch = pa.RecordBatch.from_pydict({"lang": ["m", "l", "l"], "source": ["s", "t", "s"], "text": [b"a x", b"AB a", b"a a y"]})
    (out,) = divergence.occurrences(Listed, True)([batch])
    got = {tuple(r.values()) for r in out.to_pylist()}
    assert got == {("m", "s", 0, None, 1), ("m", "s", -1, b"x", 1), ("l", "t", 1, None, 1), ("l", "t", 0, None, 1), ("l", "s", 0, None, 2), ("l", "s", -1, b"y", 1)}
