"""Vector codes against SQL that computes every distance, and against plain integers."""

import hashlib
import math

import numpy as np
import pytest

from cartulary.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, error string, ints string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the codebooks, by plain loops over integers."""
    good = sorted((i, [math.floor(4096 * x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v))
    w = len(good[0][1]) // parts
    cut = [(i, [v[p * w : p * w + w] for p in range(parts)]) for i, v in good]
    books = [[list(v[p]) for _, v in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(v[p], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v in cut:
                held.setdefault(pick(v, p), []).append(v[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(c) for c in zip(*xs)]
    out = {}
    for i, v in cut:
        entry = [pick(v, p) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e in entry), sum(dist(v[p], books[p][entry[p]]) for p in range(parts)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_query_equals_its_sql(same):
    same(queries.QUERIES["op11_vector_codes"], queries.ORACLES["op11_vector_codes"])


@pytest.mark.parametrize("spread", [1.0, 0.001])
def test_plain_loops_ties_and_odd_rows(spark, spread):
    """Small spreads make many equal parts, and so ties between entries."""
    draw = np.random.default_rng(3)
    rows = [(i, [round(float(x), 3) for x in draw.normal(0, spread, 16)], i % 3 or None, "x", "y") for i in range(90)]
    rows += [(100, rows[5][1], 1, "x", "y"), (101, rows[5][1], 1, "x", "y")]
    odd = [(200, None, 1, "", ""), (201, [], 1, "", ""), (202, [None] + [0.0] * 15, 1, "", ""), (203, [math.nan] * 16, 1, "", ""), (204, [math.inf] * 16, 1, "", ""), (205, [1.0] * 8, 1, "", "")]
    got = vector_codes.compress(spark, spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).collect()
    want, books = plain_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {books}
    by_label = {}
    for r in got:
        by_label[r["label"]] = by_label.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in got) and None in by_label


def test_few_rows_lengths_and_empty_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert vector_codes.compress(spark, table([])).collect() == []
    assert vector_codes.compress(spark, table([(1, None, 1, "", "")])).collect() == []
    got = vector_codes.compress(spark, table([(1, [0.5, -1e300, 1e300], None, "", ""), (None, [0.0, 0.0, 0.0], None, "", ""), (1, [0.5, -1e300, 1e300], None, "", "")])).collect()
    assert sorted((r["vec_id"] or 0, r["error"], r["label_error"]) for r in got) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]


def test_bounds_rule_distances_out_and_hold():
    draw = np.random.default_rng(5)
    centres = draw.integers(-9000, 9000, (16, 8))
    x = (centres[draw.integers(0, 16, 4000)] + draw.integers(-300, 300, (4000, 8))).astype(np.int64)
    book = centres + draw.integers(-500, 500, centres.shape)
    entry, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32)
    vector_codes.reassign(x, book, entry, upper, lower)
    for _ in range(3):
        new = np.array([x[entry == e].sum(0) // max(1, (entry == e).sum()) if (entry == e).any() else book[e] for e in range(16)])
        shift = np.sqrt(((new - book) ** 2).sum(1).astype(float))
        book, upper = new, vector_codes.above(upper.astype(float) + shift[entry])
        lower = vector_codes.below(lower.astype(float) - shift)
        asked = vector_codes.reassign(x, book, entry, upper, lower)
        every = vector_codes.squares(x[:, None], book[None])
        assert (entry == every.argmin(1)).all() and asked < every.size / 4
        assert (lower.astype(float) <= np.sqrt(every)).all() and (upper.astype(float) >= np.sqrt(every.min(1))).all()
