"""A directory tree as rows: listed level by level in tasks, contents read on demand.

The frontier of directories is a table; tasks expand a level and hand on, with each
directory, the names of the ignore files in force there.  The driver sees one count
for each level.  Contents are opened only of files that neither their path, their
size nor a rule leaves out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import fixed, paths
from cartulary.sources.corpus import verdict
from cartulary.sources.rules import Rule, ignored, rules_of
from cartulary.sources.staged import Staged

FOUND = "path string, size long, mtime_ms long, kind string, dark boolean, depth int, chain string, sign string"
TEXTS = "path string, adapter string, size long, mtime_ms long, text string, skip_reason string"
#: Directories that a task expands, files and bytes that a task reads, and bytes that it
#: holds at once.
DIRS, FILES, BYTES, HELD = 200, 2_000, 128_000_000, 32_000_000
NEVER = {*fixed.BUILD_DIRS, *fixed.TOOL_DIRS, fixed.INDEX_DIR}


class Entry(NamedTuple):
    name: str
    is_dir: bool
    size: int
    mtime_ms: int


class Reach:
    """Files below ``top``, from a task; links are not followed."""

    def __init__(self, top: str):
        self.local = top.removeprefix("file:") if top.startswith("file:") else None
        self.fs, self.base = (None, "") if self.local is not None else pa_fs.FileSystem.from_uri(top)

    def at(self, path: str) -> str:
        base = self.local if self.local is not None else self.base
        return f"{base.rstrip('/')}/{path}" if path else base

    def entries(self, path: str) -> Iterator[Entry]:
        if self.local is not None:
            with os.scandir(self.at(path)) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield Entry(e.name, True, 0, 0)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield Entry(e.name, False, s.st_size, s.st_mtime_ns // 1_000_000)
            return
        for e in self.fs.get_file_info(pa_fs.FileSelector(self.at(path))):
            yield Entry(e.base_name, e.type == pa_fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000)

    def read(self, path: str) -> bytes:
        if self.local is not None:
            with open(self.at(path), "rb") as f:
                return f.read()
        with self.fs.open_input_file(self.at(path)) as f:
            return f.read()


def closed(path: str) -> bool:
    """A directory that makes all below it sensitive: it is one row and isn't entered."""
    parts = path.lower().split("/")
    return parts[-1] in fixed.SECRET_DIRS or parts[-1].startswith(".env") or parts[-2:] == [".config", "gcloud"]


@functools.lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:  # a pattern that is none matches nothing
        return None


def left_out(rules: Iterable[Rule], path: str, is_dir: bool) -> bool:
    """The verdict of the first rule that matches, those that win being first."""
    for r in rules:
        if (is_dir or not r.dirs_only) and (p := compiled(r.pattern)) and p.search(r.lead + path):
            return not r.keep
    return False


def expanded(top: str, outer: list[tuple[int, int, list[Rule]]], tracked: bool) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """mapInPandas function: the entries of each directory of a frontier.

    ``outer`` are the rules from outside of the tree; those inside are named by a directory's
    ``chain`` (kind, depth, path) and read here, once for a task.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, known = Reach(top), {}

        def held(path: str) -> tuple[list[Rule], str]:
            """An ignore file's rules and its hash, opened once."""
            if path not in known:
                raw = reach.read(path)
                known[path] = rules_of(raw.decode("utf-8", "replace"), path.rpartition("/")[0] + "/" if "/" in path else ""), hashlib.sha256(raw).hexdigest()
            return known[path]

        def entries(path: str, dark: bool, depth: int, chain: list) -> Iterator[tuple]:
            prefix = f"{path}/" if path else ""
            try:
                found = list(reach.entries(path))
            except OSError:
                yield path, None, None, "walk_error", False, depth, "", None
                return
            own = {e.name for e in found if not e.is_dir}
            chain = chain + [[k, depth, prefix + n] for k, n in enumerate(fixed.IGNORE_FILES) if n in own and (n != ".gitignore" or tracked)]
            ranked = sorted([*outer, *((k, d, held(p)[0]) for k, d, p in chain)], key=lambda x: (x[0], -x[1]))
            rules, text = [r for _, _, rs in ranked for r in reversed(rs)], json.dumps(chain)
            for e in found:
                at = prefix + e.name
                if not e.is_dir:
                    sign = held(at)[1] if e.name in fixed.IGNORE_FILES else None
                    yield at, e.size, e.mtime_ms, "file", dark or left_out(rules, at, False), depth, "", sign
                elif closed(at):
                    yield at, None, None, "sensitive", False, depth, "", None
                elif e.name in fixed.TOOL_DIRS and not prefix:
                    yield at, None, None, "harness_meta", False, depth, "", None
                elif e.name not in NEVER:
                    yield at, None, None, "dir", dark or left_out(rules, at, True), depth + 1, text, None

        columns = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            for path, dark, depth, chain in zip(batch["path"], batch["dark"], batch["depth"], batch["chain"]):
                rows = []
                for row in entries(path, bool(dark), int(depth), json.loads(chain or "[]")):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield table(rows, columns)
                        rows = []
                yield table(rows, columns)

    return run


def table(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({"size": "Int64", "mtime_ms": "Int64"}) if "size" in columns else out


def converted(kind: str, raw: bytes) -> str:
    """Text of a pdf or docx file by an outside tool; no tool, no text."""
    name, command = {"pdf": ("pdftotext", lambda p: ["pdftotext", "-layout", p, "-"]), "docx": ("pandoc", lambda p: ["pandoc", "-f", "docx", "-t", "markdown", p])}[kind]
    if not shutil.which(name):
        return ""
    with tempfile.NamedTemporaryFile(suffix=f".{kind}") as f:  # the tool's input, gone with the block
        f.write(raw)
        f.flush()
        done = subprocess.run(command(f.name), capture_output=True, timeout=120)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def text_of(adapter: str, raw: bytes) -> tuple[str | None, str | None]:
    """(text, reason): what a file's content says, or why it is left out."""
    if adapter in ("pdf", "docx"):
        text = converted(adapter, raw)
        return (text, None) if text.strip() else (text, "unsupported_or_tool_missing")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None, "decode_error"
    return (None, "binary_nul") if "\0" in text else (text, None)


def opened(top: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """mapInPandas function: the listed files with text, or the reason against it.

    A file that has gone since the listing has no row.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, rows, held = Reach(top), [], 0
        columns = [c.split()[0] for c in TEXTS.split(", ")]
        for batch in batches:
            for path, adapter, size, mtime in zip(batch["path"], batch["adapter"], batch["size"], batch["mtime_ms"]):
                try:
                    raw = reach.read(path)
                except FileNotFoundError:
                    continue
                rows.append((path, adapter, size, mtime, *text_of(adapter, raw)))
                held += len(raw)
                if held > HELD:
                    yield table(rows, columns)
                    rows, held = [], 0
        yield table(rows, columns)

    return run


class Directory:
    """A corpus in a directory; called, it gives the rows that ``corpus.walk`` gives of a table.

    The tree's ignore files hold, and the rules ``ignore`` beside them; neither hides sensitive
    files, which are always reported.  One listing serves all that is asked of it until
    ``forget``.
    """

    def __init__(self, spark: SparkSession, root: str, ignore: Iterable[str] = (), markdown_only: bool = False, most: int = fixed.MAX_FILE_BYTES):
        self.spark, self.ignore, self.markdown_only, self.most = spark, tuple(ignore), markdown_only, most
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        self.staged: Staged | None = None
        self._listed: DataFrame | None = None

    def outer(self) -> tuple[list[tuple[int, int, list[Rule]]], bool]:
        """Rules from files above the tree, the version control's exclude file and the
        user's, and whether the tree is under version control at all.

        ``.gitignore`` counts up to the controlled tree's top.
        """
        jvm = self.spark._jvm
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path(*parts)
        top = path(self.top)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def read(at) -> str:
            stream = fs.open(at)
            try:
                return bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()

        found, above, lead, depth = [], top, "", 0
        git_at = (top, "") if fs.exists(path(top, ".git")) else None
        while above.getParent() is not None:
            lead, above, depth = f"{above.getName()}/{lead}", above.getParent(), depth - 1
            for kind, name in enumerate(fixed.IGNORE_FILES):
                at = path(above, name)
                if (name != ".gitignore" or git_at is None) and fs.exists(at):
                    found.append((kind, depth, rules_of(read(at), lead=lead)))
            if git_at is None and fs.exists(path(above, ".git")):
                git_at = (above, lead)
        if not git_at:
            return [x for x in found if fixed.IGNORE_FILES[x[0]] != ".gitignore"], False
        exclude, own = path(git_at[0], ".git/info/exclude"), os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")
        if fs.exists(exclude):
            found.append((len(fixed.IGNORE_FILES), 0, rules_of(read(exclude), lead=git_at[1])))
        if os.path.exists(own):
            with open(own, errors="replace") as f:
                found.append((len(fixed.IGNORE_FILES) + 1, 0, rules_of(f.read(), lead=git_at[1])))
        return found, True

    def forget(self) -> None:
        """Drops the listing; the next question lists anew."""
        if self.staged:
            self.staged.close()
        self.staged = self._listed = None

    def entries(self) -> DataFrame:
        """The tree's rows as tasks found them, a table for each level."""
        if self._listed is None:
            self.staged = Staged(self.spark)
            outer, tracked = self.outer()
            self.outer_sign = hashlib.sha256(repr((outer, self.ignore)).encode()).hexdigest()
            expand, levels, dirs = expanded(self.top, outer, tracked), [], 1
            frontier = self.spark.createDataFrame([("", False, 0, "[]")], "path string, dark boolean, depth int, chain string")
            while dirs:
                dealt = frontier.repartition(max(1, min(-(-dirs // DIRS), 10_000)), "path") if levels else frontier.coalesce(1)
                levels.append(self.staged.write(dealt.mapInPandas(expand, FOUND)))
                frontier = levels[-1].where("kind = 'dir'").select("path", "dark", "depth", "chain")
                dirs = frontier.count()
            self._listed = functools.reduce(DataFrame.unionByName, levels)
        return self._listed

    def listed(self) -> DataFrame:
        """(path, size, mtime_ms, adapter, skip_reason) of files and of directories that
        are reported, by names, sizes and rules alone."""
        found = self.entries().where("kind <> 'dir'")
        path = F.col("path")
        shown = found.where((F.col("kind") != "file") | paths.sensitive(path) | ~(F.col("dark") | ignored(self.ignore)))
        kind = paths.adapter(path)
        reason = F.when(F.col("kind") == "file", verdict(path, kind, F.col("size"), F.lit(""), self.markdown_only, self.most)).otherwise(F.col("kind"))
        return shown.select("path", "size", "mtime_ms", F.when(F.col("kind").isin("file", "sensitive"), kind).alias("adapter"), reason.alias("skip_reason"))

    def meta(self) -> DataFrame:
        """(path, size, mtime_ms, adapter) of the files that contents may come from."""
        return self.listed().where("skip_reason is null").drop("skip_reason")

    def rules_sign(self) -> str:
        """Changes with any rule that holds for the tree."""
        files = self.entries().where("sign is not null").agg(F.coalesce(F.sum(F.xxhash64("path", "sign").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
        return hashlib.sha256(f"{self.outer_sign}:{files}".encode()).hexdigest()

    def read(self, files: DataFrame) -> DataFrame:
        """``files`` (path, adapter, size, mtime_ms) with text and skip_reason: they alone
        are opened, dealt to tasks by number and size."""
        rows = files.select("path", "adapter", "size", "mtime_ms")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        tasks = max(-(-n // FILES), -(-total // BYTES), min(n, self.spark.sparkContext.defaultParallelism), 1)
        return rows.repartition(int(tasks), "path").mapInPandas(opened(self.top), TEXTS)

    def __call__(self) -> DataFrame:
        barred = self.listed().where("skip_reason is not null")
        return self.read(self.meta()).unionByName(barred, allowMissingColumns=True)
