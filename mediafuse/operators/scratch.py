"""Written intermediate tables in the folder that the driver and all executors share.

A written table cuts the lineage: an executor may be lost at any time and only the tasks that were
running are repeated.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where Spark runs in a single process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="mediafuse-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster's own clean-up of the folder remains
        pass


class Scratch:
    """Tables of one operator call. ``write`` makes one, ``drop`` deletes what is no longer read.

    What is left (the tables that the returned DataFrame reads) goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Writes df as Parquet and returns the table read back (no partitioning is carried over)."""
        path = f"{self.root}/{self._count:03d}-{label}"
        self._count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)
