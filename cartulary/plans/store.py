"""Generations: immutable snapshots of an index behind one pointer.

All access is by Hadoop's file systems, so the store may be a shared one.  The
pointer is replaced by an atomic rename; readers resolve it once and keep their
generation while later ones appear.
"""

from __future__ import annotations

import functools
import json
import os
import re
import socket
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEPT_GENERATIONS, KEPT_RUNS, LOCK_MS = 2, 20, 15 * 60 * 1000
#: Layers of a generation, and bytes of those above the lowest against its own, from
#: which they are made one.
MOST_LAYERS, MOST_ABOVE = 8, 0.5


#: Tables kept in folders by bucket; with no row there is no file to take a schema from.
BUCKETED = {"postings": "path string, term string, bucket int", "counts": "term string, df long, bucket int"}


class Store:
    """Files below ``top``, by a file system of Spark's."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, below: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(below))) if self.exists(below) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> None:
        """Replaces a file atomically; with ``new`` only creates it."""
        target = name if new else f"{name}.tmp-{time.time_ns()}"
        stream = self.fs.create(self.path(target), not new)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not new:
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf).rename(self.path(target), self.path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Busy(RuntimeError):
    """Another build holds the lock."""


class Generations(Store):
    """The index's snapshots: ``gen-<ms>`` folders, ``current``, ``build.lock``."""

    def lock(self, now_ms: int | None = None) -> None:
        """Takes the lock, or a stale one: its process is this one or a dead one of this
        machine, it is old, or it is torn and some seconds old.

        A stale lock is renamed away before a new one is made, which only one of
        several builds can do.
        """
        now = now_ms or int(time.time() * 1000)
        if self.exists("build.lock"):
            try:
                held = json.loads(self.read("build.lock"))
                stale = now - held["started_at_ms"] > LOCK_MS or held["pid"] == os.getpid() or held.get("host") == socket.gethostname() and not alive(held["pid"])
            except (ValueError, KeyError):
                stale = now - self.fs.getFileStatus(self.path("build.lock")).getModificationTime() > 10_000
            away = f"build.lock.stale-{time.time_ns()}"
            if not stale or not self.fs.rename(self.path("build.lock"), self.path(away)):
                raise Busy("another build holds the lock")
            self.delete(away)
        self.write("build.lock", json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "started_at_ms": now}), new=True)

    def publish(self, tables: dict[str, DataFrame], manifest: dict, onto: str | None = None, derived: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]] | None = None) -> str:
        """Writes a generation and lets the pointer name it.

        With ``onto`` it is a layer over that generation's: ``tables`` must then hold ``touched``,
        the paths whose rows below no longer count.  ``derived`` makes further tables from
        those just written; a column ``bucket`` names the folders of a table that has it.
        """
        self.lock()
        try:
            name = f"gen-{time.time_ns() // 1_000_000}"
            while self.exists(name):
                name = f"gen-{int(name[4:]) + 1}"
            for table, df in tables.items():
                df.write.parquet(f"{self.top}/{name}/{table}")
            for table, df in (derived(lambda t: self.spark.read.parquet(f"{self.top}/{name}/{t}")) if derived else {}).items():
                (df.write.partitionBy("bucket") if "bucket" in df.columns else df.write).parquet(f"{self.top}/{name}/{table}")
            self.write(f"{name}/manifest.json", json.dumps(manifest | {"layers": [*(self.layers(onto) if onto else []), name]}))
            self.write("current", name)
        finally:
            self.delete("build.lock")
        self.prune()
        return name

    def layers(self, generation: str) -> list[str]:
        """The folders that make a generation, the lowest first."""
        return json.loads(self.read(f"{generation}/manifest.json")).get("layers") or [generation]

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def crowded(self, generation: str) -> bool:
        """Whether a generation's layers should be made one."""
        lowest, *above = self.layers(generation)
        return len(above) >= MOST_LAYERS or bool(above) and sum(map(self.bytes, above)) > MOST_ABOVE * self.bytes(lowest)

    def open(self) -> tuple[str, dict] | None:
        """(generation, manifest) that the pointer names now."""
        if not self.exists("current"):
            return None
        name = self.read("current").strip()
        manifest = json.loads(self.read(f"{name}/manifest.json"))
        return name, {k: v for k, v in manifest.items() if k != "layers"}

    def table(self, generation: str, name: str) -> DataFrame:
        """A table of a generation: of each path the rows of the topmost layer that decides it."""
        layers = self.layers(generation)
        read = lambda layer: (self.spark.read.schema(BUCKETED[name]) if name in BUCKETED else self.spark.read).parquet(f"{self.top}/{layer}/{name}")
        if len(layers) == 1:
            return read(layers[0])
        touched = [self.spark.read.parquet(f"{self.top}/{layer}/touched").select("path") for layer in layers[1:]]
        return layered(list(map(read, layers)), touched)

    def prune(self) -> None:
        """Keeps the current generation and the newest others, and the layers that they lie on."""
        current = self.read("current").strip()
        old = sorted((n for n in self.names() if n.startswith("gen-") and n != current), key=stamp, reverse=True)
        needed = {layer for name in (current, *old[:KEPT_GENERATIONS]) if self.exists(f"{name}/manifest.json") for layer in self.layers(name)}
        for name in old[KEPT_GENERATIONS:]:
            if name not in needed:
                self.delete(name)

    def keep_run(self, envelope: dict) -> str:
        """Writes a query's whole envelope; the newest runs stay."""
        name = f"runs/{int(time.time() * 1000)}.json"
        text = json.dumps(envelope)
        self.write(name, text)
        self.write("last_run.json", text)
        for old in sorted(self.names("runs"), reverse=True)[KEPT_RUNS:]:
            self.delete(f"runs/{old}")
        return name


def layered(rows: list[DataFrame], touched: list[DataFrame]) -> DataFrame:
    """Of each path the rows of the topmost layer that decides it.

    ``touched`` (path) are the paths that each layer but the lowest decides, with rows or without.
    """
    numbered = lambda dfs, name, first: [df.withColumn(name, F.lit(i)) for i, df in enumerate(dfs, first)]
    last = functools.reduce(DataFrame.unionByName, numbered(touched, "_last", 1)).groupBy("path").agg(F.max("_last").alias("_last"))
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered(rows, "_layer", 0))
    return every.join(last, "path", "left").where("_last is null or _layer >= _last").drop("_layer", "_last")


def alive(pid: int) -> bool:
    """Whether this machine has a process of that number."""
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        return True
    return True


def stamp(name: str) -> int:
    found = re.fullmatch(r"gen-(\d+)", name)
    return int(found[1]) if found else 0


def retention(generations: DataFrame, current: Column, keep: int = KEPT_GENERATIONS, of: list[str] | None = None) -> DataFrame:
    """``generations`` (name) with ``keep``: current, or among the newest others (of each store)."""
    at = F.coalesce(F.try_to_number(F.regexp_extract("name", r"^gen-(\d+)$", 1), F.lit("9999999999999999")).cast("long"), F.lit(0))
    order = Window.partitionBy(*(of or [])).orderBy((F.col("name") == current).asc(), at.desc(), F.desc("name"))  # a store's few names
    return generations.withColumn("keep", (F.col("name") == current) | (F.row_number().over(order) <= keep))
