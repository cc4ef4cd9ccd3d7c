"""Tables in buckets of their keys, in a folder that driver and executors share, changed as a whole by versions.

A version is one small file that names, for each table, the files of each bucket. Writing it by rename is the
commit of all tables at once: readers see the old version or the new one, and a version that was interrupted is
written anew over its own files. A change rewrites the buckets that its keys fall into, or adds files to them;
the other buckets are carried over by name, so that what a batch writes follows what it touches.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A bucket to which files were added so often is rewritten as one at the next change that touches it.
MAX_PARTS = 8


@dataclass(frozen=True)
class Table:
    """Rows of ``schema``, dealt into buckets by the hash of the column ``key``. Without a schema the files' own is read."""

    schema: StructType | None
    key: str


class Store:
    """Named tables under ``folder``. ``buckets`` is chosen once, for the size that the tables shall reach."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets
        self._staged: dict[str, dict[int, list[str]]] = {}
        self._read: dict[int, dict[str, dict[int, list[str]]]] = {}  # a version never changes
        self._applied: dict[int, dict[str, int]] = {}

    # -- files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int:
        """The latest version; -1 before the first."""
        return max(self.versions(), default=-1)

    def _manifest(self, version: int) -> dict[str, dict[int, list[str]]]:
        if version < 0:
            return {name: {} for name in self.tables}
        if version not in self._read:
            file = self._fs().open(self._path(f"{self.folder}/versions/{version:012d}.json"))
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
            file.close()
            self._read = {v: m for v, m in self._read.items() if v >= version - 2}
            self._read[version] = {name: {int(b): parts for b, parts in held.get(name, {}).items()} for name in self.tables}
            self._applied[version] = held.get("", {})
        return self._read[version]

    def applied(self) -> dict[str, int]:
        """The last batch of each stream that the latest version holds."""
        version = self.version()
        self._manifest(version)
        return dict(self._applied.get(version, {}))

    # -- reading

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str | Column) -> list[int]:
        """The buckets of a table into which the keys of rows fall: as many numbers as there are buckets, at most."""
        return sorted(r.b for r in rows.select(self.bucket(F.col(key) if isinstance(key, str) else key).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table, of some buckets only if they are given."""
        held = self._manifest(self.version() if version is None else version)[name]
        return self._files(name, [p for b, ps in held.items() if buckets is None or b in buckets for p in ps])

    def read_staged(self, name: str, buckets: list[int]) -> DataFrame:
        """The rows of some buckets of a table as they will be after the commit."""
        held = self._manifest(self.version())[name] | self._staged.get(name, {})
        return self._files(name, [p for b in buckets for p in held.get(b, [])])

    def _files(self, name: str, parts: list[str]) -> DataFrame:
        schema = self.tables[name].schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*(f"{self.folder}/{p}" for p in parts))

    # -- writing

    def _write(self, name: str, rows: DataFrame, label: str, buckets: int) -> dict[int, str]:
        folder = f"data/{name}/{label}"
        own = self.bucket(F.col(self.tables[name].key))
        rows.select(*self.tables[name].schema.names, own.alias("bucket")).repartitionById(max(1, buckets), F.col("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/{folder}")
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(f"{self.folder}/{folder}") if n.startswith("bucket=")}

    def begin(self) -> None:
        """Forgets what a batch that failed has staged."""
        self._staged = {}

    def replace(self, version: int, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Stages rows as the whole content of the named buckets; a bucket without rows becomes empty."""
        made = self._write(name, rows, f"{version:012d}-whole", len(buckets)) if buckets else {}
        self._staged.setdefault(name, {}).update({b: [made[b]] if b in made else [] for b in buckets})

    def append(self, version: int, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Stages rows as further files of the named buckets; those with many files are written together."""
        if not buckets:
            return
        held = self._manifest(self.version())[name]
        full = [b for b in buckets if len(held.get(b, [])) >= MAX_PARTS]
        if full:
            own = self.bucket(F.col(self.tables[name].key))
            self.replace(version, name, self.read(name, full).unionByName(rows.where(own.isin(full))), full)
            rows, buckets = rows.where(~own.isin(full)), [b for b in buckets if b not in full]
        made = self._write(name, rows, f"{version:012d}-added", len(buckets)) if buckets else {}
        self._staged.setdefault(name, {}).update({b: [*held.get(b, []), p] for b, p in made.items()})

    def commit(self, version: int, applied: dict[str, int] | None = None) -> None:
        """Makes all that is staged the content of ``version``, and deletes files that only versions before the last two name.

        ``applied``: the batches of streams that the version holds, by the streams' names; those of other streams stay.
        """
        before = self._manifest(self.version())
        streams = self.applied() | (applied or {})
        after = {name: {b: p for b, p in (before[name] | self._staged.get(name, {})).items() if p} for name in self.tables}
        fs, folder = self._fs(), f"{self.folder}/versions"
        fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/.{version:012d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({**after, "": streams}).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{folder}/{version:012d}.json")):
            raise RuntimeError(f"version {version} is there already")
        self._staged = {}
        older = self.versions()[:-2]
        if older:
            keep = {p for v in self.versions()[-2:] for t in self._manifest(v).values() for ps in t.values() for p in ps}
            for v in older:
                for p in {p for t in self._manifest(v).values() for ps in t.values() for p in ps} - keep:
                    fs.delete(self._path(f"{self.folder}/{p}"), True)
                fs.delete(self._path(f"{folder}/{v:012d}.json"), False)

    def bytes_written(self, version: int) -> int:
        """What the version itself wrote."""
        fs = self._fs()
        return sum(fs.getContentSummary(self._path(f"{self.folder}/data/{t}/{n}")).getLength()
                   for t in self.tables for n in self._names(f"{self.folder}/data/{t}") if n.startswith(f"{version:012d}-"))


def buckets_for(rows: int, rows_a_bucket: int = 5_000_000) -> int:
    """A number of buckets for a table that shall reach so many rows."""
    return max(8, math.ceil(rows / rows_a_bucket))
