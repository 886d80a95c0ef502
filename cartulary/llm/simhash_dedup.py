"""SimHash near-duplicates found by BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from cartulary.llm.common import Saved, pick, small
from cartulary.llm.components import components

#: Bits of a fingerprint.
BITS = 64
#: Fingerprints of one shard tree; a larger shard is cut by further bits.
TREE = 8_192
#: Hashes whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space.  Fewer words
    than ``width`` make one shingle; none (or null) give 0.  A bit is 1 if over
    half the shingles' XXH64 have it.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = xxhash.xxh64_intdigest(joined, seed)
        return h - (1 << BITS) if h >> (BITS - 1) else h
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    n, counts = len(starts), np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


@pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def bk_links(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """Builds a BK-tree of distinct 64-bit values and walks it with all of them.

    The first value of a node is its root and the others hang below it, keyed by
    their integer distance to it.  A query goes on only into children whose key
    is within ``radius`` of its own distance, so that nothing nearer is missed.
    Yields (positions, node): queries within the radius of a node.  All queries
    of a node are compared at once.
    """
    first = np.arange(len(values))
    todo = [(first, first)]
    while todo:
        tree, asks = todo.pop()
        root = tree[0]
        near = np.bitwise_count(values[asks] ^ values[root])
        found = asks[near <= radius]
        found = found[found != root]
        if len(found):
            yield found, int(root)
        below = tree[1:]
        if not len(below):
            continue
        key = np.bitwise_count(values[below] ^ values[root])
        order = np.argsort(key, kind="stable")
        below, key = below[order], key[order].astype(np.int16)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for child, k in zip(np.split(below, cuts), key[np.concatenate(([0], cuts))]):
            on = asks[np.abs(near.astype(np.int16) - k) <= radius]
            if len(on) > 1 or len(on) == 1 and on[0] != child[0]:
                todo.append((child, on))


def spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a shard, one fewer than each connected group has members."""
    if len(values) == 2:
        a, b = int(values[0]), int(values[1])
        return [(b, a)] if ((a ^ b) & (2**BITS - 1)).bit_count() <= radius else []
    up = list(range(len(values)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    raw = values.view(np.uint64)
    for found, node in bk_links(raw, radius):
        at = top(node)
        for i in found.tolist():
            j = top(i)
            if j != at:
                low, high = min(at, j), max(at, j)
                up[high] = at = low
    out = ((i, top(i)) for i in range(len(values)))
    return [(int(values[i]), int(values[j])) for i, j in out if i != j]


def shard_links(radius: int):
    """mapInPandas function over rows sorted by shard: its links, shard by shard."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            keys = batch[["block", "part"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            whole = cuts[-1] if len(cuts) else 0
            values = batch["fp"].to_numpy(np.int64)
            edges = [e for vs in np.split(values[:whole], cuts[:-1]) if len(vs) > 1 for e in spanning(vs, radius)]
            yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")
            kept = batch.iloc[whole:]
        if kept is not None and len(kept) > 1:
            yield pd.DataFrame(spanning(kept["fp"].to_numpy(np.int64), radius), columns=["u", "v"], dtype="int64")

    return run


def bits_of(value: Column, mask: int) -> Column:
    """The bits of ``value`` that ``mask`` (unsigned) has."""
    return value.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def blocks(bits: list[int], count: int) -> list[int]:
    """Masks that deal ``bits`` into ``count`` blocks of near equal size."""
    size = [len(bits) // count + (i < len(bits) % count) for i in range(count)]
    at = np.cumsum([0, *size]).tolist()
    return [sum(1 << b for b in bits[at[i] : at[i + 1]]) for i in range(count)]


def links(spark: SparkSession, values: DataFrame, radius: int, saved: Saved, tree: int = TREE) -> DataFrame:
    """(u, v) that connect distinct ``fp`` at ``radius`` or fewer differing bits.

    Of radius + 1 blocks of bits two linked values share one whole, so each
    block's value names a shard and every shard has its own BK-tree.  A shard of
    over ``tree`` values is dealt anew by blocks of the bits that aren't fixed
    in it yet, by the same argument, until it is small or its free bits are few:
    that bounds a shard at every size of input.
    """
    found, todo = [], [(values.select("fp"), (), list(range(BITS)))]
    while todo:
        rows, path, free = todo.pop()
        masks = blocks(free, radius + 1)
        keyed = rows.select("fp", F.posexplode(F.array(*[bits_of(F.col("fp"), m) for m in masks])).alias("block", "part"), *path)
        names = [p for p in path]
        sizes = keyed.groupBy("block", "part", *names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = saved.write(sizes)
        last = 2 ** (len(free) - len(free) // (radius + 1)) <= tree
        small = sizes if last else sizes.where(F.col("n") <= tree)
        ids = ["block", "part", *names]
        ready = keyed.join(small.select(*ids), ids, "left_semi")
        ready = ready.select(F.hash(*ids).alias("block"), F.xxhash64(*ids).alias("part"), "fp")
        ready = ready.repartition("part").sortWithinPartitions("part", "block", "fp")
        found.append(ready.mapInPandas(shard_links(radius), "u long, v long"))
        if not last and not (large := sizes.where(F.col("n") > tree)).isEmpty():
            for i, m in enumerate(masks):
                mine = keyed.where(F.col("block") == i).join(large.select(*ids), ids, "left_semi")
                name = f"p{len(names)}"
                rest = [b for b in free if not m >> b & 1]
                todo.append((mine.select("fp", F.col("part").alias(name), *names), (name, *names), rest))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def grouped(spark: SparkSession, marked: DataFrame, id_col: str, radius: int, saved: Saved) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``marked`` (id_col, fp)."""
    lowest = saved.write(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(spark, links(spark, lowest, radius, saved), saved)
    rooted = lowest.join(roots, lowest["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """Each row's id, fingerprint ``fp`` (signed long) and ``component_id``, the
    least id that links reach, itself included.

    Rows of one fingerprint are one node, so copies are never paired.  Null and
    empty texts have fingerprint 0 and are linked like any other.  A null id is a
    component's only if it has no other.  Repeated rows stay, an empty table
    gives none, and further columns are not read.
    """
    saved = Saved(spark)
    marked = saved.write(docs.select(F.col(id_col), fingerprints(F.col(text_col)).alias("fp")))
    found = grouped(spark, marked, id_col, radius, saved)
    return marked.join(found, "fp").select(id_col, "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the least id.

    Null ids come last; of rows that share an id, repeated ones included, one
    stays.  The columns are those of ``docs``.
    """
    saved = Saved(spark)
    row, fp, at = pick(docs.columns, "_row"), pick(docs.columns, "_fp"), pick(docs.columns, "_at")
    rows = docs.withColumn(fp, fingerprints(F.col(text_col))).withColumn(row, F.monotonically_increasing_id())
    rows = saved.write(rows)
    marked = rows.select(F.col(row).alias("n"), F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    found = marked.join(grouped(spark, marked, "n", radius, saved).select("fp", "root"), "fp")
    best = found.groupBy("root").agg(F.min_by("n", F.struct(F.col("id").isNull(), "id", "n")).alias("best"))
    best = saved.write(best)
    gone = saved.write(found.join(small(best), "root").where("n <> best").select(F.col("n").alias(at)))
    return rows.join(small(gone), F.col(row) == F.col(at), "left_anti").select(*docs.columns)
