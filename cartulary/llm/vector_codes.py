"""Compression of vectors to short codes: Lloyd's rounds for each part, pruned by Elkan's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import Saved, small

#: Parts of a vector, entries of a part's codebook, rounds, and steps in a unit.
PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Integer components end here on both sides, so that squared distances fit in 64 bits.
LIMIT = 1 << 26
STATE = "ints array<int>, entry array<int>, upper array<float>, lower array<float>"


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def integers(vector: Column, parts: int = PARTS) -> Column:
    """floor(STEPS * x) for each component, zeros added up to a multiple of ``parts``."""
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * STEPS), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return F.concat(whole, F.array_repeat(F.lit(0), F.pmod(-F.size(vector), F.lit(parts)).cast("int")))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def below(d: np.ndarray) -> np.ndarray:
    """Single-precision numbers of no more than ``d``."""
    return np.maximum(np.nextafter(d.astype(np.float32), np.float32(-np.inf)), 0)


def above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d.astype(np.float32), np.float32(np.inf))


def reassign(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each row of ``x`` (integers) to its nearest entry, in place; how many
    distances were computed.

    ``upper`` bounds a row's distance to its entry from above, ``lower`` those to all
    entries from below.  An entry is passed over only if a bound says that it is
    strictly further; what is left is decided by exact integer squares, ties by
    the lower index.
    """
    between = np.sqrt(squares(book[:, None], book[None]).astype(float)) * (0.5 - 1e-9)
    ruled = (upper[:, None] < lower) | (upper[:, None] < between[entry])
    ruled[np.arange(len(x)), entry] = True
    open_ = np.flatnonzero(~ruled.all(1))
    if not open_.size:
        return 0
    mine = entry[open_]
    exact = squares(x[open_], book[mine])
    near = above(np.sqrt(exact))
    lower[open_, mine] = below(np.sqrt(exact))
    row, other = np.nonzero(~(ruled[open_] | (near[:, None] < lower[open_]) | (near[:, None] < between[mine])))
    d = squares(x[open_[row]], book[other])
    lower[open_[row], other] = below(np.sqrt(d))
    known = np.full((open_.size, len(book)), np.iinfo(np.int64).max)
    known[np.arange(open_.size), mine] = exact
    known[row, other] = d
    entry[open_] = best = known.argmin(1)
    upper[open_] = above(np.sqrt(known[np.arange(open_.size), best]))
    return open_.size + row.size


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), kind))


def moved(books: np.ndarray, shift: np.ndarray | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: one assignment of every part.

    ``books`` is (part, entry, component), ``shift`` how far each entry has come since
    the last assignment, by which the rows' bounds are widened; None for the first one.
    """
    parts, k, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("ints"), n).reshape(n, parts, width).astype(np.int64)
            if shift is None:
                entry, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, k), np.float32)
            else:
                entry = matrix(batch.column("entry"), n).astype(np.int64)
                lower = below(matrix(batch.column("lower"), n).reshape(n, parts, k).astype(float) - shift)
                upper = above(matrix(batch.column("upper"), n).astype(float) + np.take_along_axis(shift[None], entry[:, :, None], 2)[:, :, 0])
            for p in range(parts):
                e, u, low = entry[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                reassign(x[:, p], books[p], e, u, low)
                entry[:, p], upper[:, p], lower[:, p] = e, u, low
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("ints"), lists(entry, pa.int32()), lists(upper, pa.float32()), lists(lower, pa.float32())], names=["id", "label", "ints", "entry", "upper", "lower"])

    return run


def added(parts: int, k: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: a task's sums, (slot, count, total) for each component of
    each entry in use, slot counting parts, entries and components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, entry = matrix(batch.column("ints"), n).reshape(n, parts, width).astype(np.int64), matrix(batch.column("entry"), n)
            for p in range(parts):
                count[p] += np.bincount(entry[:, p], minlength=k)
                np.add.at(total[p], entry[:, p], x[:, p])
        slot = np.flatnonzero(np.repeat(count.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(np.repeat(count.ravel(), width)[slot]), pa.array(total.ravel()[slot])], names=["slot", "count", "total"])

    return run


def replaced(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of its parts' mean; unused ones stay."""
    parts, k, width = books.shape
    sums = state.select("ints", "entry").mapInArrow(added(parts, k, width), "slot long, count long, total long")
    out = books.copy().ravel()
    for r in sums.groupBy("slot").agg(F.sum("count").alias("n"), F.sum("total").alias("total")).collect():  # a codebook's components
        out[r["slot"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def measured(books: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: the code in hexadecimal digits and its squared error."""
    parts, _, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, entry = matrix(batch.column("ints"), n).reshape(n, parts, width).astype(np.int64), matrix(batch.column("entry"), n)
            error = sum(squares(x[:, p], books[p][entry[:, p]]) for p in range(parts))
            code = [bytes(row).hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each usable vector.

    A part's codebook starts as that part of the rows with the least ids; each round
    assigns every part to its nearest entry and replaces the entries by the floors
    of their means; a last assignment follows.  Between rounds each row keeps, for
    each part, its entry, an upper bound and a lower bound for every entry in a
    written table, so that a round computes only distances that the bounds leave
    open, and a lost executor repeats one round's tasks.  The driver sees codebooks.

    Rows whose vector is null, empty or holds null or non-finite components are
    dropped, and so are those of another length than the row with the least id.
    Components beyond LIMIT / STEPS count as that; a length that ``parts`` doesn't
    divide is filled with zeros.  Null ids come last; rows of one id are ordered by
    their vectors and are rows of their own; fewer rows than ``entries`` make smaller codebooks.  Null labels are one label.  A table
    without usable rows gives none.  Other columns don't matter.
    """
    saved = Saved(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = rows.select("id", "label", integers(F.col("v"), parts).alias("ints"), F.size("v").alias("n"))
    first = rows.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    kinds = dict(zip(rows.columns, (f.dataType.simpleString() for f in rows.schema)))
    final = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not first:
        none = spark.createDataFrame([], final)
        return none.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit(digest(np.zeros(0))).alias("codebooks_sha256"))
    n = first[0]["n"]
    start = np.array([r["ints"] for r in first if r["n"] == n], np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    state, shift = rows.where(F.col("n") == n).drop("n"), None
    for at in range(rounds + 1):
        was = state
        state = saved.write(was.mapInArrow(moved(books, shift), f"id {kinds['id']}, label {kinds['label']}, {STATE}"))
        if shift is not None:
            saved.drop(was)
        if at < rounds:
            new = replaced(state, books)
            shift = np.nextafter(np.sqrt(squares(new, books).astype(float)), np.inf)
            books = new
    done = saved.write(state.mapInArrow(measured(books), final))
    saved.drop(state)
    per_label = saved.write(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = done.join(small(per_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
