"""Source trees as a data source: a partition per source, folders listed when and only when rows of them are asked for."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not

from tesserae.ship import ship

# Folders with so many files that an index leaves them to be looked up later.
LAZY = ("terrain", "textures")


class SourceTree(DataSource):
    """Rows (source, folder, path, size, mtime) of the files below each folder of `path`, folder being the first part of path, empty for files at the top.

    The tree must be mounted wherever tasks run. Filters on source and folder decide what is listed; links to folders are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "source string, folder string, path string, size long, mtime timestamp"

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")
        self.only: dict[str, set[str]] = {}
        self.never: dict[str, set[str]] = {"source": set(), "folder": set()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can from filters on source and folder, and leaves the filters in place, so that rows are right whatever it takes."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            at = ".".join(inner.attribute) if isinstance(inner, (EqualTo, In)) else None
            if at in self.never:
                values = {inner.value} if isinstance(inner, EqualTo) else set(inner.value)
                if isinstance(f, Not):
                    self.never[at] |= values
                else:
                    self.only[at] = self.only.get(at, values) & values
            yield f

    def _asked(self, column: str, value: str) -> bool:
        return value not in self.never[column] and (column not in self.only or value in self.only[column])

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.path) as d:
            return [InputPartition(e.name) for e in sorted(d, key=lambda e: e.name) if e.is_dir() and not e.name.startswith(".") and self._asked("source", e.name)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = f"{self.path}/{partition.value}"
        todo = [""]
        while todo:
            at = todo.pop()
            with os.scandir(f"{root}/{at}") as d:
                for e in d:
                    path = f"{at}/{e.name}" if at else e.name
                    folder = path.split("/", 1)[0] if "/" in path else ""
                    if e.is_dir(follow_symlinks=False):
                        if self._asked("folder", path.split("/", 1)[0]):
                            todo.append(path)
                    elif self._asked("folder", folder):
                        s = e.stat()
                        yield partition.value, folder, path, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """All files of the sources below path; filter by source and folder before anything else, and nothing else is listed."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(path)


def partial_index(spark: SparkSession, path: str) -> DataFrame:
    """The files that an index holds at once: all but those of the folders that are looked up later, which are not listed."""
    return tree(spark, path).where(~F.col("folder").isin(*LAZY))


def lazily(spark: SparkSession, path: str, source: str, folder: str) -> DataFrame:
    """The files of one folder of one source."""
    return tree(spark, path).where((F.col("source") == source) & (F.col("folder") == folder))
