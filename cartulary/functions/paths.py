"""Predicates and properties of paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions import fixed
from cartulary.functions.text import ascii_lower, strings


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased ending after the last dot; a name that starts with its only dot has none."""
    return F.regexp_extract(ascii_lower(file_name(path)), r"^.+\.([^.]*)$", 1)


def adapter(path: Column) -> Column:
    end = extension(path)
    return F.when(end.isin(*fixed.PROSE_EXTENSIONS), "markdown").when(end.isin("pdf", "docx"), end).otherwise("code")


def is_prose(adapter_: Column) -> Column:
    return adapter_.isin("markdown", "pdf", "docx")


def pruned(path: Column) -> Column:
    """Lies in a directory that is never entered."""
    above = F.split(path, "/")
    return F.arrays_overlap(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))), strings((*fixed.BUILD_DIRS, *fixed.TOOL_DIRS, fixed.INDEX_DIR)))


def sensitive(path: Column) -> Column:
    """Likely to hold a secret, by its name alone."""
    parts = F.split(ascii_lower(path), "/")
    name = F.element_at(parts, -1)
    above = F.slice(parts, 1, F.size(parts) - 1)
    ssh = F.lit(False)
    for key in fixed.SSH_KEYS:
        ssh |= name.startswith(key)
    out = F.arrays_overlap(parts, strings(fixed.SECRET_DIRS)) | F.concat(F.lit("/"), ascii_lower(path), F.lit("/")).contains("/.config/gcloud/")
    out |= F.exists(above, lambda p: p.startswith(".env")) | name.startswith(".env") | name.endswith(".env")
    out |= name.isin(*fixed.SECRET_NAMES) | (ssh & ~name.endswith(".pub")) | name.contains("credentials")
    for suffix in fixed.SECRET_SUFFIXES:
        out |= name.endswith(suffix)
    return out


def binary(path: Column) -> Column:
    return extension(path).isin(*fixed.BINARY_EXTENSIONS)


def about_project(path: Column) -> Column:
    """A file of instructions, memory, licences or locks: a tag, not a filter."""
    name, out = file_name(path), path.startswith("memory/") | path.startswith(".claude/")
    for agent in fixed.AGENT_FILES:
        out |= (path == agent) | path.contains(f"/{agent}")
    return out | name.startswith(".") | name.isin(*fixed.META_NAMES)


def parent(path: Column) -> Column:
    """The directory, "." for the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")
