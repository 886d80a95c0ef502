"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from cartulary.llm.common import pick

#: Bytes of a window; filter widths; filters of each; dimensions of a byte.
WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: documents of a language, excerpts of each.
PER_LANG, EXCERPTS = 400, 4
#: Windows that go through the network at once.
BATCH = 128
#: What a text without a letter is, and the columns that a prediction has.
NONE = "und"
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass
class Network:
    """Byte embedding, filters of several widths, max pooling, softmax.

    ``filters`` has a column for each filter; those narrower than the widest
    have zeros in their last rows.
    """

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(patches, place of each filter's maximum, maxima) for (n, WINDOW) bytes."""
        x = self.embed[windows]
        wide = max(WIDTHS)
        patches = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), wide * DIMS, axis=1)[:, ::DIMS]
        found = np.ascontiguousarray(patches).reshape(-1, wide * DIMS) @ self.filters
        found = found.reshape(len(x), -1, found.shape[1])
        at = found.argmax(axis=1)
        return patches, at, np.take_along_axis(found, at[:, None], axis=1)[:, 0] + self.bias

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows].reshape(len(windows), -1)
        wide = max(WIDTHS) * DIMS
        patches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, wide, axis=1)[:, ::DIMS])
        found = (patches.reshape(-1, wide) @ self.filters).reshape(len(windows), -1, self.filters.shape[1]).max(axis=1)
        return softmax(np.maximum(found + self.bias, 0) @ self.dense + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """The whole text's bytes, A-Z lower-cased, as rows of WINDOW; the last is filled with zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 4e-3, seed: int = 42) -> Network:
    """Fits by Adam on cross-entropy in batches of 64; the same input gives the same network."""
    rng, wide, n_out = np.random.default_rng(seed), max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DIMS)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    net = Network(langs, scale(256, DIMS) * 16, scale(wide * DIMS, n_out) * mask, np.zeros(n_out, np.float32), scale(n_out, len(langs)), np.zeros(len(langs), np.float32))
    names = ("embed", "filters", "bias", "dense", "out_bias")
    first, second, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            mine = order[at : at + 64]
            patches, place, top = net.pooled(windows[mine])
            hidden = np.maximum(top, 0)
            error = softmax(hidden @ net.dense + net.out_bias)
            error[np.arange(len(mine)), labels[mine]] -= 1
            error /= len(mine)
            back = (error @ net.dense.T) * (top > 0)
            chosen = np.take_along_axis(patches, place[:, :, None], axis=1)
            grad = {"dense": hidden.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "filters": np.einsum("bfk,bf->kf", chosen, back) * mask}
            spread = back[:, :, None] * net.filters.T[None]
            grad["embed"] = np.zeros_like(net.embed)
            bytes_ = windows[mine][np.arange(len(mine))[:, None, None], place[:, :, None] + np.arange(wide)]
            np.add.at(grad["embed"], bytes_, spread.reshape(*bytes_.shape, DIMS))
            t += 1
            for k in names:
                g = grad[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def excerpts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, each: int) -> list[tuple[str, str]]:
    """(language, excerpt): at most about ``per_lang`` documents of a language, those
    with the least hashes, and ``each`` places of a document."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = known.groupBy(lang_col).agg(F.count(F.lit(1))).collect()
    if not counts:
        return []
    part = F.create_map(*[F.lit(v) for lang, n in counts for v in (lang, min(1.0, per_lang / n))])
    share = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    place = [F.pmod(F.xxhash64(id_col, F.lit(k)), F.greatest(F.length(text_col) - WINDOW, F.lit(1))) + 1 for k in range(each)]
    cuts = F.array(*[F.substring(F.col(text_col), p.cast("int"), F.lit(WINDOW)) for p in place])
    taken = known.where(share < F.element_at(part, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.explode(cuts).alias("cut"))
    most = 2 * per_lang * each * len(counts)
    order = [F.xxhash64("cut"), F.col("lang"), F.col("cut")]  # so that equal ids, which share a hash, are bounded alike each time
    return sorted((r[0], r[1]) for r in taken.orderBy(*order).limit(most).collect())


def held_out(id_: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, each: int = EXCERPTS) -> Network | None:
    """A network from labelled rows that aren't held out; None without any."""
    found = excerpts(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), id_col, text_col, lang_col, per_lang, each)
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    windows = np.concatenate([windows_of(cut)[:1] for _, cut in found])
    return train(windows, np.array([langs.index(lang) for lang, _ in found]), langs)


def scored(net: Network, texts: list[str]) -> Iterator[tuple[str, float]]:
    """Language and score of each text: its windows' probabilities, weighted by
    their bytes, all windows of all texts BATCH at a time."""
    sums = np.zeros((len(texts), len(net.langs)))
    weights = np.zeros(len(texts))
    rows, owner = [], []

    def flush() -> None:
        block = np.concatenate(rows)
        who = np.concatenate(owner)
        for at in range(0, len(block), BATCH):
            part, of = block[at : at + BATCH], who[at : at + BATCH]
            w = (part != 0).sum(axis=1).astype(float)
            np.add.at(sums, of, net.probabilities(part) * w[:, None])
            np.add.at(weights, of, w)
        rows.clear()
        owner.clear()

    held = 0
    for i, text in enumerate(texts):
        mine = windows_of(text)
        rows.append(mine)
        owner.append(np.full(len(mine), i))
        held += len(mine)
        if held >= 64 * BATCH:
            flush()
            held = 0
    if rows:
        flush()
    for s, w in zip(sums, weights):
        best = int(s.argmax())
        yield net.langs[best], float(min(1.0, s[best] / w)) if w else 0.0


def predictor(net: Network | None, unlearnt: str = NONE):
    """Column function from texts to (lang_pred, score); without a network a text
    with a letter is ``unlearnt``."""

    @pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        plain = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        found = scored(net, [t for t, ok in zip(texts, plain) if ok]) if net else repeat((unlearnt, 0.0))
        return pd.DataFrame([next(found) if ok else (NONE, 0.0) for ok in plain], columns=PREDICTION.names)

    return predict


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", names: tuple[str, str] = ("lang_pred", "score"), unlearnt: str = NONE, **bounds: int) -> DataFrame:
    """``docs`` with the predicted language and its probability as ``names``.

    The network learns from a bounded sample (``per_lang``, ``each``) of labelled
    rows that aren't held out, and then reads every whole text, window by window;
    label and id play no part in a prediction.  A text that is null or has no
    letter is "und" with score 0; if there is no labelled row, the others are
    ``unlearnt`` with score 0.  Repeated rows get equal predictions; an empty table gives none; a
    column with one of ``names`` is replaced.
    """
    found = predictor(learn(docs, id_col, text_col, lang_col, **bounds), unlearnt)(F.col(text_col))
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    both = pick(docs.columns, "_found")
    got = docs.withColumn(both, found)
    return got.select(*keep, F.col(f"{both}.lang_pred").alias(names[0]), F.col(f"{both}.score").alias(names[1]))


def accepted(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that have no language: null texts and those
    without a letter, whatever the label, prediction or score, and also if there
    is no labelled row to learn from."""
    names = (pick(docs.columns, "_lang_pred"), pick(docs.columns, "_score"))
    return identify(spark, docs, names=names, unlearnt="", **options).where(F.col(names[0]) != NONE).select(*docs.columns)
