"""Work dealt over the tasks of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tasks(rows: DataFrame) -> int:
    """Two tasks a core at least, and as many as the session's shuffles have."""
    spark = rows.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all tasks, by keys if there are any.

    Files are read by their bytes: millions of short rows that compress well are one task's, however long the work on
    each takes. Rows dealt by number stay so, where adaptive execution would join small partitions again.
    """
    return rows.repartition(tasks(rows), *keys)
