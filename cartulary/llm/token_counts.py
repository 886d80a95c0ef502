"""Token counts by a map-side lookup of pre-token lengths in two tiers."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterable
from itertools import islice

import pandas as pd
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: Most entries of the broadcast table; words that a task names for it, and that
#: it counts at once.
FREQUENT = 60_000
NAMED, COUNTED = 4_000, 500_000
#: Most pre-tokens that a worker remembers besides; beyond it starts anew.
CACHED = 400_000
#: Characters of one text that are split at once; longer texts go in blocks.
BLOCK = 1 << 20


class PreTokens:
    """Splits texts as the tokenizer does and knows pre-tokens' token counts.

    A text that holds a special string goes to the library whole.
    """

    def __init__(self, path: str, pattern: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.frequent, self.cache = frequent, dict(frequent)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, tokens: Iterable[str]) -> None:
        new = list(set(tokens).difference(self.cache))
        if len(self.cache) + len(new) > CACHED + len(self.frequent):
            self.cache = dict(self.frequent)
            new = list(set(tokens).difference(self.cache))
        if new:
            self.cache.update(zip(new, self.encode(new)))

    def add(self, tokens: list[str]) -> int:
        try:
            return sum(map(self.cache.__getitem__, tokens))
        except KeyError:
            self.learn(tokens)
            return sum(map(self.cache.__getitem__, tokens))

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return self.encode([text])[0]
        if len(text) <= BLOCK:
            return self.add(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        return sum(map(self.add, iter(lambda: list(islice(found, BLOCK // 8)), [])))


_worker: dict[str, PreTokens] = {}


def counts(texts: pd.Series, key: str, path: str, pattern: str, table: Broadcast) -> pd.Series:
    """One PreTokens lives in a worker from batch to batch and task to task."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = PreTokens(path, pattern, table.value)
    one = _worker[key].count
    return pd.Series([one(t) if t else 0 for t in texts], dtype="int64")


def counter(spark: SparkSession, path: str, pattern: str, frequent: dict[str, int]):
    """Column function from texts to token counts; null counts as empty."""
    table, key = spark.sparkContext.broadcast(frequent), uuid.uuid4().hex

    @pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return counts(texts, key, path, pattern, table)

    return count


def words_named(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: a task's NAMED commonest words, of all its texts.

    Of more than COUNTED words the commonest quarter goes on, so memory is bounded.
    """
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            for at in range(0, len(text or ""), BLOCK):
                seen.update(text[at : at + BLOCK].split())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
    yield pd.DataFrame([(w, n) for w, n in seen.most_common(NAMED) if n > 1], columns=["word", "n"]).astype({"word": object, "n": "int64"})


def frequent_lengths(docs: DataFrame, text_col: str, path: str, pattern: str, most: int = FREQUENT) -> dict[str, int]:
    """First tier: token counts of the pre-tokens of the commonest words of all texts.

    Words are counted where the texts lie, and only a task's commonest are
    shuffled and added up; no pre-token is.  The table has at most about ``most``
    entries at any input size.  It only saves work: a pre-token that it lacks is
    encoded where it occurs, so results don't depend on it.
    """
    named = docs.select(F.col(text_col).alias("text")).mapInPandas(words_named, "word string, n long")
    total = named.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    pre = PreTokens(path, pattern, {})
    names = sorted({t for (w,) in total.select("word").collect() for t in pre.pattern.findall(f" {w}") if not (pre.special and pre.special.search(t))})
    return dict(zip(names, pre.encode(names))) if names else {}


def token_counts(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text_col: str = "text", limit: int = 1024, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``docs`` with UTF-8 bytes, tokens and whether these are over ``limit``.

    ``path`` names a byte-level tokenizer of the tokenizers library without
    normalizer, ``pattern`` its pre-token pattern; then a pre-token's count
    doesn't depend on its neighbours.  Tokens are those of the whole text without
    begin and end tokens; special strings in it count as the library has them.
    Null texts count as empty.  No row is dropped or moved: the plan has no
    shuffle of rows.  A column of ``docs`` with one of ``names`` is replaced.
    """
    count = counter(spark, path, pattern, frequent_lengths(docs, text_col, path, pattern))
    n_bytes, n_tokens, over = names
    return docs.withColumns({n_bytes: F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), n_tokens: count(F.col(text_col))}).withColumn(over, F.col(n_tokens) > limit)
