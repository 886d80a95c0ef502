import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartulary.llm import best_fit, token_counts
from cartulary.llm.queries import QUERIES

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b \n\n c", "it's I'LL", "x<|endoftext|>y <|startoftext|>z <|ENDOFTEXT|>", "ΑΣ σας İ. é ́a ﬁ ½² 中文 가나", "a\x1cb\x85c\xa0d", "ends. here, now.", "no\r\nend \t", "é. É"]


def strange(n, seed):
    rnd = random.Random(seed)
    letters = "aAbZéÉßẞİıΣσςΑа́̈ .,'!'sS<|>endoftext123½²٣中ﬁ ẞǅ\x85\x1c한\n\t’"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 50))) for _ in range(n)]


def test_pre_token_counts_equal_the_library(monkeypatch):
    texts = ODD + strange(3000, 1)
    lib = Tokenizer.from_file(BYTES)
    want = [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]
    pre = token_counts.PreTokens(BYTES, public_tokenizers.PATTERN, {" the": 1})
    assert [pre.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    monkeypatch.setattr(token_counts, "CACHED", 50)
    pre = token_counts.PreTokens(BYTES, public_tokenizers.PATTERN, {})
    assert [pre.count(t) for t in texts] == want


def test_word_ids_equal_the_library(monkeypatch):
    texts = ODD + strange(3000, 2)
    lib = Tokenizer.from_file(WORDS)
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert best_fit.WordIds(WORDS).ids(texts) == want
    monkeypatch.setattr(best_fit, "BLOCK", 16)
    monkeypatch.setattr(best_fit, "CACHED", 50)
    ids = best_fit.WordIds(WORDS)
    assert [ids.ids([t])[0] for t in texts] == want


def test_counts_on_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 8), (2, "", 9)], "doc_id long, text string, n_bytes int")
    got = token_counts.token_counts(spark, df, BYTES, public_tokenizers.PATTERN, limit=1).orderBy("doc_id", "n_tokens").collect()
    assert [tuple(r) for r in got] == [(None, None, 0, 0, False), (1, "a b", 3, 2, True), (1, "a b", 3, 2, True), (2, "", 0, 0, False)]
    assert token_counts.token_counts(spark, df.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


def test_whole_table_counts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = Tokenizer.from_file(BYTES).encode_batch([r["text"] for r in rows], add_special_tokens=False)
    want = {r["doc_id"]: (len(r["text"].encode()), len(e), len(e) > 1024) for r, e in zip(rows, found)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op3_token_counts"](spark, sf).collect()} == want


def check_bins(lengths, bins, offsets, capacity, pieces, cost):
    at = {}
    for n, b, o in sorted(zip(lengths, bins, offsets), key=lambda x: (x[1], x[2])):
        used, count, spent = at.get(b, (0, 0, 0))
        assert o == used
        at[b] = (used + n, count + 1, spent + n * n)
    assert all(u <= capacity and c <= pieces and s <= cost for u, c, s in at.values())
    return len(at)


@pytest.mark.parametrize("pieces,cost", [(1000, 10**6), (3, 10**6), (1000, 400_000)])
def test_best_fit_holds_every_constraint(pieces, cost):
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.integers(1, 700, 3000), int(cost**0.5))
    n = check_bins(lengths.tolist(), *[x.tolist() for x in best_fit.best_fit(lengths, 1000, pieces, cost)], 1000, pieces, cost)
    least = max(lengths.sum() / 1000, len(lengths) / pieces, (lengths.astype(float) ** 2).sum() / cost)
    assert n <= least * 1.25 + 1


def plain_best_fit(lengths, full, weights):
    """The definition: every open bin is tried for every piece."""
    bins, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        piece = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, rest in enumerate(bins):
            after = [r - p for r, p in zip(rest, piece)]
            if min(after) >= 0:
                norm = sum(w * (a / f) ** 2 for w, a, f in zip(weights, after, full))
                if best is None or norm < best[0] - 1e-12:
                    best = (norm, b)
        if best is None:
            bins.append(list(full))
            best = (0, len(bins) - 1)
        where[i] = best[1]
        bins[best[1]] = [r - p for r, p in zip(bins[best[1]], piece)]
    return where


@pytest.mark.parametrize("full", [(1000, 1000, 10**6), (1000, 4, 10**6), (1000, 1000, 300_000)])
def test_best_fit_equals_trying_every_bin(full):
    rng = np.random.default_rng(9)
    lengths = rng.choice(rng.integers(1, 700, 40), 150)
    for weights in (best_fit.WEIGHTS, (1.0, 0.3, 0.7)):
        got = best_fit.best_fit(lengths, *full, weights)[0].tolist()
        assert got == plain_best_fit(lengths.tolist(), full, weights)


def test_each_constraint_alone_changes_the_packing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 500, 2000)
    free = best_fit.best_fit(lengths, 1000, 1000, 10**6)[0]
    by = {name: best_fit.best_fit(lengths, *full)[0] for name, full in {"tokens": (600, 1000, 10**6), "pieces": (1000, 3, 10**6), "cost": (1000, 1000, 200_000)}.items()}
    assert all(b.max() > free.max() for b in by.values())
    weighed = best_fit.best_fit(lengths, 1000, 1000, 10**6, (0.0, 1.0, 0.0))[0]
    assert (weighed != free).any()
    assert best_fit.best_fit(np.array([900, 900, 10]), 1000, 10, 100_000)[0].tolist() == [0, 1, 2]  # too dear to share


def test_tiny_texts_fill_their_sequences():
    for n in (20_000, 4096, 4097):
        assert best_fit.best_fit(np.ones(n, np.int64))[0].max() + 1 == -(-n // 4096)


def test_equal_lengths_pack_fast():
    lengths = np.full(20_000, 2100)
    assert best_fit.best_fit(lengths)[0].max() == 19_999


def test_packing_round_trip(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    lib = Tokenizer.from_file(WORDS)
    ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 1] for d, t in rows.items()}
    got = [r.asDict() for r in QUERIES["op8_best_fit"](spark, sf).collect()]
    seen = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["start"] == 4096 * r["piece"]
        seen.setdefault(r["doc_id"], 0)
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(i) for d, i in ids.items()}
    n = check_bins([r["length"] for r in got], [r["sequence_id"] for r in got], [r["offset"] for r in got], 4096, 10**9, 10**18)
    assert n <= sum(seen.values()) / 4096 * 1.02 + 1


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (4, "word " * 9000)], "doc_id long, text string")
    got = best_fit.pack(spark, df, WORDS).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in got) == [(-1, 1), (1, 1), (1, 1), (4, 809), (4, 4096), (4, 4096)]
    assert best_fit.pack(spark, df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack(spark, df, WORDS, most_pieces=0)


def test_white_space_that_the_tokenizer_does_not_split_at():
    """Signs at which str.split cuts a word and the tokenizer may not, ASCII words and others in any case."""
    words = best_fit.WordIds(WORDS)
    texts = [f"one{c}Two THREE, ΣΟΣ étÉ. x" for c in ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ")]
    assert words.ids(texts) == [np.array(words.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_of_the_cache_before_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(best_fit, "CACHED", 40)
    words = best_fit.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    encoded, plain = [], words.encode_plain
    monkeypatch.setattr(words, "encode_plain", lambda many: (encoded.extend(many), plain(many))[1])
    one, two = (" ".join(f"{c}{d}{end}" for d in "abcdefghijklmno" for end in ("ing", "ed")) for c in "vw")
    texts = (one, two, " ".join(one.split()[:5]))
    got = [words.ids([text])[0] for text in texts]
    assert got == [np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert len(encoded) == len(set(encoded)) == 60
    assert len(words.cache) <= 40
