"""Tables that end a lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset and Spark is one process, a
    fresh folder, which the session then keeps."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Staged:
    """Written tables below one folder; ``close`` deletes them all."""

    def __init__(self, spark: SparkSession, top: str | None = None):
        self.spark, self.count = spark, 0
        self.top = top or f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` as a written table, in folders by a column if one is named."""
        path = f"{self.top}/{self.count}"
        self.count += 1
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
