"""Helpers shared by the operators: shared-folder tables and gapless numbering."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one numbering task sorts, on average, and the least number of such tasks.
NUMBERING_ROWS, LEAST_BUCKETS = 10_000, 64
#: Most bytes of a table that is broadcast, and what a row takes besides its values.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 40


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and all of Spark runs in this process (tests), a fresh folder
    is chosen and kept in the session; on a cluster that is refused, since no
    machine's own folder is shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Saved:
    """Tables written to the shared folder, so that lineage ends there and an
    executor's loss costs nothing that was finished.

    Results read them lazily, so they stay until ``sweep``, which a job calls when
    it has written what it wants.  With ``tidy`` a table's shuffle files go as soon as
    it is written; nothing may read them again.  Such tables are packed tighter.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.top = f"{shared_folder(spark)}/cartulary-{uuid.uuid4().hex}"
        self.count = 0
        tops().append(self.top)

    def write(self, df: DataFrame, to: DataFrame | None = None, by: str | None = None) -> DataFrame:
        """``df`` as a written table, with a folder for each value of ``by``; or what has
        been written to ``to`` and ``df``."""
        path = f"{self.top}/{self.count}" if to is None else to._saved_at
        self.count += to is None
        writer = df.write.mode("append")
        writer = writer.option("compression", "zstd") if self.tidy else writer
        with cleaned(self.spark) if self.tidy else contextlib.nullcontext():
            writer.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        return out

    def drop(self, df: DataFrame, folder: str = "") -> None:
        """Deletes a table of ``write``, or a folder of it, that nothing reads any more."""
        delete(self.spark, f"{df._saved_at}/{folder}".rstrip("/"))

    def clear(self, since: int, *kept: DataFrame) -> None:
        """Deletes the tables from number ``since`` on, but for ``kept``."""
        stay = {df._saved_at for df in kept}
        for path in (f"{self.top}/{i}" for i in range(since, self.count)):
            if path not in stay:
                delete(self.spark, path)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes a query's shuffle files when the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_mine = threading.local()


def tops() -> list[str]:
    """Folders of the tables that this thread's operators have saved, oldest first."""
    return _mine.__dict__.setdefault("tops", [])


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this thread's operators have saved, but for those in the
    first ``since`` folders."""
    while len(tops()) > since:
        delete(spark, tops().pop())


def small(table: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint only if its rows take BROADCAST_BYTES at
    most; otherwise Spark joins by shuffles.

    Numbers count as 8 bytes and arrays and strings by their length, so the bound
    is on bytes, whatever the rows hold.
    """
    fixed, grows = ROW_BYTES, []
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            grows.append(F.octet_length(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            grows.append(8 * F.size(f.name))
        else:
            fixed += 8 * (len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1)
    bytes_ = table.count() * fixed
    if grows and bytes_ <= BROADCAST_BYTES:
        bytes_ += sum(n or 0 for n in table.agg(*map(F.sum, grows)).first())
    return F.broadcast(table) if bytes_ <= BROADCAST_BYTES else table


def pick(names: list[str], wish: str) -> str:
    """``wish``, or a variant that no column has."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def gapless(df: DataFrame, group: list[str], order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... in each group, without one task per group.

    Rows go to hashed buckets by their order columns; the buckets' counts give
    each one an offset, and only a bucket is sorted.  Equal rows are
    interchangeable, so the numbering depends on values alone.
    """
    n = df.count() if rows is None else rows
    buckets = max(LEAST_BUCKETS, -(-n // NUMBERING_ROWS))
    b, at = pick(df.columns, "_bucket"), pick(df.columns, "_offset")
    keyed = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*group, b).agg(F.count(F.lit(1)).alias(at))
    of = {c: pick(df.columns, f"{c}_of") for c in (*group, b)}
    counts = counts.select(at, *[F.col(c).alias(of[c]) for c in of])
    before = Window.partitionBy(*[of[c] for c in group]).orderBy(of[b]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(at, F.coalesce(F.sum(at).over(before), F.lit(0)))
    joined = keyed.join(offsets, [F.col(c).eqNullSafe(F.col(of[c])) for c in of]).drop(*of.values())
    rank = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order))
    return joined.withColumn(out, (F.col(at) + rank - 1).cast(T.LongType())).drop(b, at)
