"""An index that follows a stream of files: each batch makes a generation.

The source is a folder of Parquet files of (path, text) that grows.  A batch is written
as a layer over the generation before it, with its own rows alone; readers let the
topmost layer decide each path, and layers are made one when they are many or large against
the lowest.  A replayed batch makes no other result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartulary.functions import paths
from cartulary.operators import cards
from cartulary.plans import engine
from cartulary.plans.store import Generations
from cartulary.sources import corpus
from cartulary.sources.staged import Staged

def latest(files: DataFrame) -> DataFrame:
    """One row for each path of a batch; of several texts, that with the largest hash."""
    return files.withColumn("hash", F.sha2("text", 256)).groupBy("path").agg(F.max_by("text", "hash").alias("text"))


def layer(store: Generations, batch: DataFrame, staged: Staged, generation: str | None) -> dict[str, DataFrame]:
    """The tables of a batch of files (path, text): its own rows, and the paths whose rows in
    the generation below no longer count."""
    files = latest(batch).withColumn("adapter", paths.adapter(F.col("path")))
    drafts = staged.write(cards.drafts(corpus.walk(files)))
    good = drafts.where("skip_reason is null")
    known = None
    if generation:
        old = store.table(generation, "cards").join(good.select("path"), "path", "left_semi")
        known = cards.model_fields(old)
    tables = engine.index_tables(cards.carded(good, known), drafts, corpus.rejected(drafts))
    return tables | ({"touched": drafts.select("path").distinct()} if generation else {})


def merged(store: Generations, generation: str) -> dict[str, DataFrame]:
    """A generation's tables with its layers made one."""
    return {name: store.table(generation, name) for name in ("cards", "terms", "meta", "skipped")}


def follow(spark: SparkSession, source: str, top: str, checkpoint: str, after: Callable[[str], None] | None = None, model: str = "none") -> StreamingQuery:
    """Indexes what is there and not yet indexed, in batches, and ends (availableNow).

    The checkpoint remembers which files have been read; started again it goes on
    with new ones.  Generations are those of ``Engine.index`` with this ``model``:
    either may go on from the other's, and model fields of unchanged texts stay.
    """
    store = Generations(spark, top)
    manifest = cards.manifest(model)

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        opened, staged = store.open(), Staged(spark, f"{store.top}/work-{uuid.uuid4().hex}")
        below = opened[0] if opened and opened[1].get("layout") == manifest["layout"] else None
        try:
            name = store.publish(layer(store, batch, staged, below), manifest | {"batch": number}, below, engine.posted)
        finally:
            staged.close()
        if store.crowded(name):
            name = store.publish(merged(store, name), manifest | {"batch": number}, derived=engine.posted)
        if after:
            after(name)

    stream = spark.readStream.schema("path string, text string").parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
