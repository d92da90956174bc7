"""File trees as a DataFrame, and files as rows with hash, language and module.

Spark's own file index hides names that begin with a dot or an underscore, which belong to a project, so trees are
listed by a Python data source that never enters folders a project excludes; files are read by tasks, in splits of
about equal size, and handed over as Arrow batches. The root is a folder that all executors share.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.filters import excluded, included
from lodestrata.functions.ids import content_hash
from lodestrata.functions.paths import detect_language, extract_module
from lodestrata.sources.config import Project


def glob_matches(name: str, pattern: str) -> bool:
    """A glob over one segment: `*`, `?`, `[...]`, backslash; a malformed pattern matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return False
            out += pattern[i : end + 1]
            i = end
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                return False
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    try:
        return re.fullmatch(out, name, re.S) is not None
    except re.error:
        return False


def is_excluded(path: str, patterns: tuple[str, ...]) -> bool:
    """One path or folder against all patterns; callers test each folder on the way down."""
    base = path.rpartition("/")[2]
    return any(path.startswith(p) or glob_matches(base, p) or (p.endswith("/") and p in path) for p in patterns)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


SPLIT = 64 << 20  # bytes of files that one task reads, unless one file is larger
BATCH = 8 << 20  # bytes of contents handed over at once


class TreeReader(DataSourceReader):
    """Lists a tree, without entering excluded folders, and reads its files in splits of about equal size."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extensions = tuple(x.lower() for x in options.get("extensions", "").split("\n") if x)
        self.patterns = tuple(x for x in options.get("excludes", "").split("\n") if x)

    def listed(self) -> Iterator[tuple[str, int]]:
        todo = [] if is_excluded(".", self.patterns) else [""]
        while todo:
            folder = todo.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    rel = f"{folder}/{e.name}" if folder else e.name
                    if is_excluded(rel, self.patterns):
                        continue
                    if e.is_dir():
                        if not e.is_symlink():
                            todo.append(rel)
                    elif "." in e.name and "." + e.name.rpartition(".")[2].lower() in self.extensions:
                        yield rel, e.stat().st_size

    def partitions(self) -> list[InputPartition]:
        parts, own, size = [], [], 0
        for rel, n in self.listed():
            if own and size + n > SPLIT:
                parts.append(Part(own))
                own, size = [], 0
            own.append(rel)
            size += n
        return [*parts, Part(own)] if own or not parts else parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for rel in partition.paths:
            full = os.path.join(self.root, rel)
            with open(full, "rb") as f:
                rows.append((full, rel, f.read()))
            size += len(rows[-1][2])
            if size >= BATCH:
                yield to_batch(rows)
                rows, size = [], 0
        if rows:
            yield to_batch(rows)


def to_batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["abs_path", "rel_path", "content"])


class FileTree(DataSource):
    """`spark.read.format("filetree")` with the options path, extensions and excludes (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "abs_path string, rel_path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, project: Project, base: str = "") -> DataFrame:
    """project_id, file_path, file_hash, language, module, text of the files of a project."""
    spark.dataSource.register(FileTree)
    tree = spark.read.format("filetree").option("path", project.full_path(base)).option("extensions", "\n".join(project.include_extensions)).option("excludes", "\n".join(project.exclude_paths)).load()
    return describe(tree.select(F.lit(project.project_id).alias("project_id"), F.col("rel_path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.col("content").cast("string").alias("text")))


def describe(files: DataFrame) -> DataFrame:
    """`files` with language and module by path, and the hash of their text if they have none."""
    if "file_hash" not in files.columns:
        files = files.withColumn("file_hash", content_hash("text"))
    return files.withColumns({"language": detect_language("file_path"), "module": extract_module("file_path")})


def filtered(files: DataFrame, config: DataFrame) -> DataFrame:
    """Files that their project includes and doesn't exclude. `config` has a row for each project, so it is small."""
    rules = config.select("project_id", "include_extensions", "exclude_paths")
    both = files.join(rules, "project_id")
    return both.where(included(F.col("file_path"), F.col("include_extensions")) & ~excluded(F.col("file_path"), F.col("exclude_paths"))).drop("include_extensions", "exclude_paths")
