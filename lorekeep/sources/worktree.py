"""A work tree as a data source: its folders are listed by many tasks, and limits of depth and of kinds go down to the listing.

The tree must lie where every executor sees it under one path. Links are left out, be they to files or folders, and so are folders that
scans ignore. Two listings of a tree give its changes by times and sizes (:func:`changes`), without reading a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from .files import IGNORED_NAMES

SCHEMA = "path string, ext string, depth int, bytes long, modified_ms long"


@dataclass
class Folders(InputPartition):
    """Folders that a task lists, and whether it goes below them."""

    paths: tuple[tuple[str, bool], ...]


class WorkTree(DataSource):
    """``spark.read.format("worktree").option("tree", folder)``; options: ``ignore`` (names, comma-separated), ``maxDepth``."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = os.path.realpath(options["tree"])
        self.ignored = frozenset(options["ignore"].split(",")) if "ignore" in options else frozenset(IGNORED_NAMES)
        self.depth = int(options.get("maxDepth", 1 << 30))
        self.kinds: frozenset[str] | None = None
        self.spread = int(options.get("partitions", 32))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Depths bound the walk, endings the rows; other filters stay with the engine."""
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("depth",):
                self.depth = min(self.depth, int(f.value))
            elif isinstance(f, LessThan) and f.attribute == ("depth",):
                self.depth = min(self.depth, int(f.value) - 1)
            elif isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.kinds = frozenset([f.value]) & (self.kinds if self.kinds is not None else frozenset([f.value]))
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.kinds = frozenset(f.value) & (self.kinds if self.kinds is not None else frozenset(f.value))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """Folders of the first levels, until there are a few for each task; the driver lists no more than those."""
        whole, single = [self.root], []
        while whole and len(whole) < 4 * self.spread:
            below = [d for p in whole for d in self._folders(p)]
            single += whole
            if not below or self._level(below[0]) > self.depth:
                whole = []
                break
            whole = below
        paths = [(p, True) for p in whole] + [(p, False) for p in single]
        return [Folders(tuple(paths[i :: self.spread])) for i in range(min(self.spread, len(paths)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        waiting = list(partition.paths)
        while waiting:
            folder, deep = waiting.pop()
            level = self._level(folder)
            if level > self.depth:
                continue
            if deep:
                waiting += [(d, True) for d in self._folders(folder)]
            for e in self._entries(folder):
                if e.is_file(follow_symlinks=False):
                    ext = os.path.splitext(e.name)[1].lower().lstrip(".")
                    if self.kinds is None or ext in self.kinds:
                        stat = e.stat(follow_symlinks=False)
                        yield os.path.relpath(e.path, self.root).replace(os.sep, "/"), ext, level, stat.st_size, stat.st_mtime_ns // 1_000_000

    def _level(self, folder: str) -> int:
        rel = os.path.relpath(folder, self.root)
        return 0 if rel == "." else rel.count(os.sep) + 1

    def _entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as entries:
                return sorted(entries, key=lambda e: e.name)
        except (FileNotFoundError, PermissionError, NotADirectoryError):
            return []  # gone, or not for us, since it was listed

    def _folders(self, folder: str) -> list[str]:
        return [e.path for e in self._entries(folder) if e.is_dir(follow_symlinks=False) and e.name not in self.ignored]


def work_tree(spark: SparkSession, tree: str, **options: object) -> DataFrame:
    """``path, ext, depth, bytes, modified_ms`` of a tree's files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkTree)
    reader = spark.read.format("worktree").option("tree", tree)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change`` between two listings: added, removed, or modified where time or size differ."""
    a = before.select("path", F.struct("modified_ms", "bytes").alias("_a"))
    b = now.select("path", F.struct("modified_ms", "bytes").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", change.alias("change"))
