"""Source trees: a Python data source that lists every file below a root, and a step that reads them.

Spark's binaryFile reader leaves out names that start with ``.`` or ``_``; this source keeps them. Links to
folders are not followed. Excluded folder names are not entered. Filters on suffix, size, name and relative path are
taken over by the reader (Spark hands them over where spark.sql.python.filterPushdown.enabled is set): a file that fails
one is never listed, and a folder that no wanted path is below is never entered. The driver looks at folders only down to the level
that gives enough partitions; tasks list the rest, and the listed files are dealt anew by path before any is opened.
Driver and executors must see the root under one path.
"""

from __future__ import annotations

import datetime
import json
import operator
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.languages import BINARY_SUFFIXES, EXCLUDED_NAMES, language

LISTED = "path string, rel_path string, name string, suffix string, size bigint, mtime timestamp"
SCHEMA = f"{LISTED}, content binary"
PLANNED = 64
FLUSH_BYTES = 2 << 20


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


_ORDERED = {ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
_TEXT = {ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__}
FILTERED = ("suffix", "size", "name", "rel_path")


def _test(f: ds.Filter) -> tuple[str, Callable[[object], bool]] | None:
    """The filter as a column and a test of its value (true only where SQL says true), or None if it isn't known."""
    if isinstance(f, ds.Not):
        inner = _test(f.child) if isinstance(f.child, ds.EqualTo | ds.In | ds.StringStartsWith | ds.StringEndsWith | ds.StringContains) else None
        return inner and (inner[0], lambda v, inner=inner[1]: v is not None and not inner(v))
    if len(f.attribute) != 1 or (column := f.attribute[0]) not in FILTERED:
        return None
    if isinstance(f, ds.IsNotNull):
        return column, lambda v: v is not None
    wanted = f.value
    if isinstance(f, ds.In):
        return (column, lambda v: v in wanted) if None not in wanted else None
    if isinstance(f, ds.EqualTo) and wanted is not None:
        return column, lambda v: v == wanted
    if (holds := _ORDERED.get(type(f))) and wanted is not None:
        return column, lambda v: v is not None and holds(v, wanted)
    if (holds := _TEXT.get(type(f))) and wanted is not None:
        return column, lambda v: holds(v, wanted)
    return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.skip = set(json.loads(options.get("skipnames", "[]")))
        self.tests: list[tuple[str, Callable[[object], bool]]] = []
        self.prefix = ""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if (test := _test(f)) is None:
                yield f
                continue
            self.tests.append(test)
            if isinstance(f, ds.StringStartsWith | ds.EqualTo) and test[0] == "rel_path" and len(f.value) > len(self.prefix):
                self.prefix = f.value

    def _enters(self, folder: str) -> bool:
        """Whether a wanted path may be below the folder."""
        below = f"{os.path.relpath(folder, self.root)}/".replace(os.sep, "/").removeprefix("./")
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def _below(self, folder: str) -> list[str]:
        try:
            return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and e.name not in self.skip and self._enters(e.path))
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        """Folders down to the level that has PLANNED of them: those above it alone, those on it with all below."""
        level, above = [self.root], []
        while level and len(level) < PLANNED:
            above += level
            level = [p for folder in level for p in self._below(folder)]
        return [_Folders([(f, False) for f in above]), *[_Folders([(f, True)]) for f in level]]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        by_name, by_size = [t for t in self.tests if t[0] != "size"], [holds for column, holds in self.tests if column == "size"]
        for folder, deep in partition.folders:
            for top, folders, names in os.walk(folder):
                folders[:] = sorted(f for f in folders if f not in self.skip and self._enters(os.path.join(top, f))) if deep else []
                for name in sorted(set(names) - self.skip):
                    path = os.path.join(top, name)
                    relative, suffix = os.path.relpath(path, self.root).replace(os.sep, "/"), os.path.splitext(name)[1].lower()
                    known = {"suffix": suffix, "name": name, "rel_path": relative}
                    if not all(holds(known[column]) for column, holds in by_name):
                        continue
                    try:
                        info = os.stat(path)
                        size, changed = info.st_size, datetime.datetime.fromtimestamp(info.st_mtime)
                    except OSError:
                        size = changed = None
                    if all(holds(size) for holds in by_size):
                        yield path, relative, name, suffix, size, changed


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; option skipNames (JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def with_content(listed: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Listed files with their content: null for binary, too large and unreadable ones. Files are dealt by path, so
    that a large folder is read by many tasks."""
    names = listed.columns
    at_path, at_suffix, at_size = (names.index(c) for c in ("path", "suffix", "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, start, size = [], 0, 0
            for i, (path, suffix, n) in enumerate(zip(*(b.column(j).to_pylist() for j in (at_path, at_suffix, at_size)))):
                content = None
                if n is not None and suffix not in BINARY_SUFFIXES and (max_bytes is None or n <= max_bytes):
                    try:
                        with open(path, "rb") as f:
                            content = f.read()
                    except OSError:
                        pass
                held.append(content)
                size += len(content or b"")
                if size >= FLUSH_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    held, start, size = [], i + 1, 0

    return listed.repartition("path").mapInArrow(run, SCHEMA)


def list_tree(spark: SparkSession, root: str, skip_names=EXCLUDED_NAMES) -> DataFrame:
    """Files below ``root`` without their content; filters on it reach the reader."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("source_tree").option("skipNames", json.dumps(list(skip_names))).load(root)


def read_tree(spark: SparkSession, root: str, skip_names=EXCLUDED_NAMES, max_bytes: int | None = None, where: Column | None = None) -> DataFrame:
    """Files below ``root`` with parts, language and content (see ``with_content``). ``where`` is a condition on what is
    listed (suffix, size, rel_path, name): files that fail it aren't listed, let alone opened."""
    listed = list_tree(spark, root, skip_names)
    listed = listed if where is None else listed.where(where)
    return with_content(listed, max_bytes).withColumns({"parts": F.split("rel_path", "/"), "language": language(F.col("name"))})


def read_ignore_lines(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """Lines of the root's ignore file (tens of rules, as a rule); none if it is missing or can't be read."""
    try:
        with open(os.path.join(root.removeprefix("file://"), name), encoding="utf-8", errors="ignore") as f:
            return f.read().splitlines()
    except OSError:
        return []
