"""Corpora as DataFrames: (path, text, adapter, hash) and the rows that are left out.

Tables and JSON suites come in by Spark's readers, directories by ``tree``.  All
reasons to leave a file out are one ordered chain, so each row has one verdict.
"""

from __future__ import annotations

import collections
import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import fixed, paths

#: Virtual extensions of table rows, by the id's last digit.
EXTENSIONS = ("pdf", "docx", "rs", "rs", "rs", "md", "md", "md", "md", "md")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual_path(id_: Column, source: Column, lang: Column) -> Column:
    """source/lang/doc_00000042.md: a path for a row of ``documents``."""
    ending = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (id_ % 10 + 1).cast("int"))
    return F.concat_ws("/", source, lang, F.concat(F.lit("doc_"), F.lpad(id_.cast("string"), 8, "0"), F.lit("."), ending))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``documents`` as files: doc_id, path, text, adapter."""
    path = virtual_path(F.col("doc_id"), F.col("source"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text").withColumn("adapter", paths.adapter(F.col("path")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").alias("text")).withColumn("adapter", paths.adapter(F.col("path")))


def verdict(path: Column, adapter: Column, size: Column, content: Column, markdown_only: bool = False, most: int = fixed.MAX_FILE_BYTES) -> Column:
    """Why a file is left out, null if it isn't; the first reason in this order wins."""
    gate = F.lit(markdown_only) & (adapter != "markdown")
    converted = adapter.isin("pdf", "docx")
    return (
        F.when(gate, "unsupported_markdown_gate")
        .when(paths.sensitive(path), "sensitive")
        .when(paths.binary(path), "binary_or_unsupported")
        .when(~converted & (size > most), "too_large")
        .when(~converted & ~F.is_valid_utf8(content), "decode_error")
        .when(~converted & (F.instr(content, "\0") > 0), "binary_nul")
    )


def walk(files: DataFrame, markdown_only: bool = False, most: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """``files`` (path, text, ...) outside of pruned directories, with ``skip_reason``."""
    kept = files.where(~paths.pruned(F.col("path")))
    reason = verdict(F.col("path"), F.col("adapter"), F.octet_length("text"), F.col("text"), markdown_only, most)
    return kept.withColumn("skip_reason", reason).unionByName(tool_dirs(files), allowMissingColumns=True)


def tool_dirs(files: DataFrame) -> DataFrame:
    """(path, skip_reason): a row for each tool directory at the top that holds a file."""
    top = F.split("path", "/")
    found = files.where((F.size(top) > 1) & top[0].isin(*fixed.TOOL_DIRS))
    return found.select(top[0].alias("path"), F.lit("harness_meta").alias("skip_reason")).distinct()


def accepted(walked: DataFrame) -> DataFrame:
    return walked.where("skip_reason is null").drop("skip_reason").withColumn("hash", F.sha2("text", 256))


def rejected(walked: DataFrame) -> DataFrame:
    """(path, reason, adapter), each once."""
    return walked.where("skip_reason is not null").select("path", F.col("skip_reason").alias("reason"), "adapter").dropDuplicates(["path", "reason"])


def churn(changes: DataFrame, key: str, at: str, days: int = fixed.CHURN_DAYS) -> DataFrame:
    """(key, churn): changes in the last ``days`` before the latest one."""
    last = changes.agg(F.max(at).alias("last"))
    recent = changes.join(F.broadcast(last)).where(F.col(at) >= F.col("last") - F.make_interval(days=F.lit(days)))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("churn"))


def version_control_churn(spark: SparkSession, root: str, days: int = fixed.CHURN_DAYS) -> DataFrame | None:
    """(path, churn): how many commits of the last ``days`` touched each file below
    ``root``; None where that is no git tree, or git is not there.

    A log is read on the driver line by line; what is kept is a count for each
    changed path.
    """
    if not shutil.which("git"):
        return None
    command = ["git", "-c", "core.quotePath=false", "-C", root, "log", f"--since={days} days ago", "--name-only", "--relative", "--pretty=format:"]
    counts: collections.Counter[str] = collections.Counter()
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as log:
        counts.update(line for line in map(str.strip, log.stdout) if line)
    return spark.createDataFrame(list(counts.items()), "path string, churn long") if log.returncode == 0 else None


def suite(spark: SparkSession, path: str) -> DataFrame:
    """A golden suite (JSON): a row for each query."""
    schema = "queries array<struct<id:string,corpus_root:string,query:string,must_find:array<struct<id:string,fact:string,file:string,line:int>>,poison:array<struct<id:string,fact:string>>,negative:boolean>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("queries"))
