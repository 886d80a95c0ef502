"""Packing documents into sequences by vector best-fit."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import Saved

#: Tokens of one sequence, its most pieces, and its most attention cost (the
#: sum of its pieces' squared lengths, as for attention within documents).  As
#: given neither pieces nor cost can take a sequence more than tokens alone do.
CAPACITY = 4096
MOST_PIECES = CAPACITY
MOST_COST = CAPACITY * CAPACITY
#: What a full share of tokens, pieces and cost left over weighs in the norm.
WEIGHTS = (1.0, 0.1, 0.1)
#: Pieces that one task packs, on average.
PACK_ROWS = 20_000
#: Most words that a worker has in its cache; beyond it starts anew and remembers the cache
#: before, from which words that come again are taken over.
CACHED = 600_000
#: Characters of one text that are encoded at once.
BLOCK = 1 << 20

#: Texts looked up at once, and words encoded as one string.
TEXTS, JOINED = 64, 256

#: White space for str.split but not for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"\s")


def oddly_spaced(text: str) -> bool:
    """Holds some ODD_SPACE; a search for each is many times faster than a pattern."""
    return any(c in text for c in ODD_SPACE)


class WordIds:
    """Token ids of whole texts, word by word.

    For a tokenizer whose pre-tokens hold no white space the ids of a text are
    those of its words, one after the other.  Words not known yet are encoded
    many at once.  Those of lower-case letters alone are one pre-token each and
    go to the tokenizer's model as they are; others are told apart by their
    tokens' offsets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.cache, self.before = Tokenizer.from_file(path), {}, {}
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = self.library.model.end_of_word_suffix, self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def encode_plain(self, words: list[str]) -> None:
        """Words that are one pre-token each: each ends at the first token that ends a word."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, found in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            self.cache.update((w, raw[i:j]) for w, i, j in zip(group, [0, *cuts], cuts))

    def encode(self, words: list[str]) -> None:
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, found in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            begins = np.cumsum([0, *(len(w) + 1 for w in group)])
            cuts = (np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(found)), begins) * 4).tolist()
            raw = np.array(found.ids, "<u4").tobytes()
            self.cache.update((w, raw[i:j]) for w, i, j in zip(group, cuts, cuts[1:]))

    def unknown(self, words: set[str]) -> set[str]:
        """Those of ``words`` that neither cache has; what the one before has is taken over."""
        words = words.difference(self.cache)
        again = self.before.keys() & words
        self.cache.update(zip(again, map(self.before.__getitem__, again)))
        return words - again

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks.  A mark after a letter or digit is a
        pre-token, and letters' case makes no difference (but for a sigma's, which
        depends on its place), so that most are made of known parts."""
        if len(self.cache) + len(words) > CACHED:
            self.cache, self.before = {}, self.cache
        whole, marked = {}, {}
        for w in self.unknown(words):
            if w.isascii() and w.isalpha():
                whole[w] = w.lower()
                continue
            core, mark = (w[:-1], w[-1]) if w[-1] in ".," and w[-2:-1].lower().isalnum() else (w, "")
            if core.isalpha() and (core.isascii() or (is_normalized("NFC", core) and "\u03a3" not in core)):
                core = core.lower()
            if mark:
                marked[w] = (core, mark)
            else:
                whole[w] = core
        new = self.unknown({*whole.values(), *(p for pair in marked.values() for p in pair)})
        plain = [p for p in new if p.isalpha() and p == p.lower() and (p.isascii() or is_normalized("NFC", p))] if self.ends.any() else []
        self.encode_plain(plain)
        self.encode(list(new.difference(plain)))
        ids = self.cache.__getitem__
        self.cache.update(zip(whole, map(ids, whole.values())))
        self.cache.update([(w, ids(core) + ids(mark)) for w, (core, mark) in marked.items()])
        return self.cache

    def look_up(self, many: list[list[str]]) -> list[bytes]:
        found = [list(map(self.cache.get, words)) for words in many]
        gaps = [[i for i, v in enumerate(ids) if v is None] if None in ids else () for ids in found]
        missing = {words[i] for words, at in zip(many, gaps) for i in at}
        if missing:
            new = self.learn(missing)
            for words, ids, at in zip(many, found, gaps):
                for i in at:
                    ids[i] = new[words[i]]
        return [b"".join(ids) for ids in found]

    def long(self, text: str) -> bytes:
        """Of a text too long for one go: blocks that end at white space."""
        out, at = [], 0
        while at < len(text):
            end = next((m.start() for m in SPACE.finditer(text, min(at + BLOCK, len(text)))), len(text))
            out += self.look_up([text[at:end].split()])
            at = end
        return b"".join(out)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [len(t) <= BLOCK and not oddly_spaced(t) for t in texts]
        found = iter(self.look_up([t.split() for t, ok in zip(texts, plain) if ok]))
        return [next(found) if ok else self.odd(t) for t, ok in zip(texts, plain)]

    def odd(self, text: str) -> bytes:
        if oddly_spaced(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.long(text)


_worker: dict[str, WordIds] = {}


def piece_rows(path: str, end_id: int, capacity: int):
    """mapInPandas function: the pieces of each text, with their ids' CRC-32."""
    key = uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from pieces(batches, key, path, end_id, capacity)

    return run


def pieces(batches: Iterable[pd.DataFrame], key: str, path: str, end_id: int, capacity: int) -> Iterator[pd.DataFrame]:
    if key not in _worker:
        _worker.clear()
        _worker[key] = WordIds(path)
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity
    for batch in batches:
        out, texts = [], batch["text"].fillna("").tolist()
        ids = (raw for i in range(0, len(texts), TEXTS) for raw in _worker[key].ids(texts[i : i + TEXTS]))
        for id_, tie, raw in zip(batch["id"], batch["tie"], ids):
            raw += end
            for i, at in enumerate(range(0, len(raw), width)):
                part = raw[at : at + width]
                out.append((id_, tie, i, at // 4, len(part) // 4, zlib.crc32(part)))
        frame = pd.DataFrame(out, columns=["id", "tie", "piece", "start", "length", "ids_crc32"])
        yield frame.astype({"id": "Int64"})


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, most_pieces: int = MOST_PIECES, most_cost: int = MOST_COST, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by vector best-fit decreasing.

    A piece is a vector: its tokens, one document and its attention cost.  Pieces
    come in falling length; of all open bins that hold one under every constraint
    it takes that whose residual vector, each part over its capacity, then has the
    least weighted norm (the oldest of equals), and a new bin if none holds it.  A
    piece whose cost alone is over the capacity has a bin of its own.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.array([capacity, most_pieces, most_cost], np.float64)
    scale = np.array(weights) / full**2
    rest, name = np.zeros((3, 64)), np.zeros(64, np.int64)  # of open bins; so many are in use:
    used, made, least = 0, 0, int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        n = int(lengths[i])
        piece = np.array([n, 1, n * n], np.float64)[:, None]
        after = rest[:, :used] - piece
        fits = np.flatnonzero((after >= 0).all(axis=0))
        if len(fits):
            at = int(fits[(scale @ after[:, fits] ** 2).argmin()])
        else:
            if used == len(name):
                open_ = np.flatnonzero((rest[0] >= least) & (rest[1] >= 1) & (rest[2] >= least * least))
                used = len(open_)
                rest[:, :used], name[:used] = rest[:, open_], name[open_]
                if used * 2 > len(name):
                    rest, name = np.hstack([rest, np.zeros_like(rest)]), np.hstack([name, np.zeros_like(name)])
            at, used = used, used + 1
            rest[:, at], name[at] = full, made
            made += 1
        bins[i], offsets[i] = name[at], capacity - rest[0, at]
        rest[:, at] -= piece[:, 0]
    return bins, offsets


def packed(capacity: int, most_pieces: int, most_cost: int):
    """applyInPandas function: a group's pieces with their bin and offset."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "piece"], ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, most_pieces, most_cost)
        rows["sequence_id"], rows["offset"] = rows["part"].to_numpy(np.int64) * 2**32 + bins, offsets
        return rows[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, most_pieces: int = MOST_PIECES, most_cost: int = MOST_COST, id_col: str = "doc_id", text_col: str = "text", rows: int = PACK_ROWS) -> DataFrame:
    """Sequences of at most ``capacity`` tokens, as a row for each piece.

    A document is its text's ids (null: none) and ``end_id``; ``path`` names a
    tokenizer whose pre-tokens hold no white space.  Longer documents alone are
    cut, into pieces of ``capacity`` and a rest.  A sequence has ``most_pieces``
    pieces and ``most_cost`` of attention cost at most; a piece that costs more
    has a sequence of its own.  Columns: the id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.  Groups of about ``rows``
    pieces, dealt by a hash of id, text and piece, are packed at once, each with
    less than two sequences to spare, so no task's work grows with the input.
    Capacities under 1 are refused; repeated rows are packed each; a null id stays
    null; an empty table gives none; other columns are not read.
    """
    if min(capacity, most_pieces, most_cost) < 1:
        raise ValueError("a sequence must hold a token, a piece and its cost")
    saved = Saved(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("tie"), F.col(text_col).alias("text"))
    cut = saved.write(own.mapInPandas(piece_rows(path, end_id, capacity), "id long, tie long, piece int, start long, length long, ids_crc32 long"))
    parts = max(1, -(-cut.count() // rows))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("tie", "piece"), F.lit(parts)).cast("int"))
    done = dealt.groupBy("part").applyInPandas(packed(capacity, most_pieces, most_cost), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_col)
