"""Plug-in catalogues as a Spark data source, for batches and for streams.

A plug-in is a function that makes records of one page of an answer. ``spark.read.format("mediafuse_plugin")`` runs it in
the tasks, over the files of a folder, a group of files to a task. Filters on the origin and on the pages' numbers reach the
source, so that files that cannot hold a row are not opened. What fails while a page is read is a row of its own
(``failure``), and the other pages, and the other records of the page, go on.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "mediafuse_plugin"
#: Columns of every plug-in, before those of its own records. ``page`` is the file's place in the order of names.
COMMON = "origin string, page long, failure string"
FILES_A_TASK = 16


@dataclass(frozen=True)
class Plugin:
    """``records`` makes the records (dicts of the columns in ``schema``, and ``origin``) of a page's parsed document."""

    origin: str
    schema: str
    records: Callable[[object], Iterator[dict]]


def named(entry: str) -> Plugin:
    """The plug-in at ``module:name``."""
    module, _, name = entry.partition(":")
    found = getattr(importlib.import_module(module), name)
    if not isinstance(found, Plugin):
        raise TypeError(f"{entry} is no plug-in")
    return found


def files(path: str) -> list[str]:
    """The data files of a folder by name, in any file system that pyarrow knows."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _text(path: str, file: str) -> str:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(path)
    with store.open_input_stream(file) as stream:  # compressed files by the ending of their name
        return stream.read().decode()


@dataclass
class Pages(InputPartition):
    """Files of one task, with their places."""

    files: list[tuple[int, str]]

    def __init__(self, pages: list[tuple[int, str]]):
        super().__init__(None)
        self.files = pages


def _failed(why: Exception) -> str:
    return f"{type(why).__name__}: {why}".splitlines()[0][:200]


def read_pages(plugin: Plugin, path: str, names: list[str], pages: list[tuple[int, str]], whole: bool = False) -> Iterator[tuple]:
    """Rows of the files: records of the plug-in's own origin, and one row for whatever failed. A file is a JSON document a line, or one as a whole."""
    for page, file in pages:
        try:
            raw = _text(path, file)
        except Exception as why:  # noqa: BLE001  one file must not fail the others
            yield (plugin.origin, page, _failed(why), *(None for _ in names))
            continue
        for line in [raw] if whole else raw.split("\n"):
            if not line.strip():
                continue
            try:
                made = iter(plugin.records(json.loads(line)))
                while (record := next(made, None)) is not None:
                    if record.get("origin", plugin.origin) == plugin.origin:
                        yield (plugin.origin, page, None, *(record.get(n) for n in names))
            except Exception as why:  # noqa: BLE001  one document must not fail the others
                yield (plugin.origin, page, _failed(why), *(None for _ in names))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.entry, self.per_task = options["path"], options["plugin"], int(options.get("filespertask", FILES_A_TASK))
        self.names, self.whole = schema.names[3:], options.get("multiline", "false").lower() == "true"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes filters on origin and page; the others are left to Spark."""
        ours = (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, ours) and f.attribute in (("origin",), ("page",)):
                self.pushed.append(f)
            else:
                yield f

    def _passes(self, value, attribute: str) -> bool:
        tests = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, IsNotNull: lambda f: True, GreaterThan: lambda f: value > f.value,
                 GreaterThanOrEqual: lambda f: value >= f.value, LessThan: lambda f: value < f.value, LessThanOrEqual: lambda f: value <= f.value}
        return all(tests[type(f)](f) for f in self.pushed if f.attribute == (attribute,))

    def partitions(self) -> list[Pages]:
        found = [(i, f) for i, f in enumerate(files(self.path)) if self._passes(i, "page")] if self._passes(named(self.entry).origin, "origin") else []
        return [Pages(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return read_pages(named(self.entry), self.path, self.names, partition.files, self.whole)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of their names; a batch is those that came since the last one. The offset counts them."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.entry, self.per_task = options["path"], options["plugin"], int(options.get("filespertask", FILES_A_TASK))
        self.most = int(options.get("maxfilespertrigger", 1 << 30))
        self.names, self.whole = schema.names[3:], options.get("multiline", "false").lower() == "true"
        self.given = 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.given = min(len(files(self.path)), self.given + self.most)
        return {"files": self.given}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.given = max(self.given, end["files"])
        found = list(enumerate(files(self.path)))[start["files"] : end["files"]]
        return [Pages(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return read_pages(named(self.entry), self.path, self.names, partition.files, self.whole)


class PluginSource(DataSource):
    """Options: ``plugin`` (module:name), ``path`` (a folder), ``multiline`` (true: a file is one document), ``filespertask`` and, for streams, ``maxfilespertrigger``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{COMMON}, {named(self.options['plugin']).schema}"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.dataSource.register(PluginSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, entry: str, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("plugin", entry).option("path", path).load()


def records(rows: DataFrame) -> DataFrame:
    """The records, without what failed."""
    return rows.where(F.col("failure").isNull()).drop("failure")


def failures(rows: DataFrame) -> DataFrame:
    """(origin, page, failure) of all that failed."""
    return rows.where(F.col("failure").isNotNull()).select("origin", "page", "failure")
