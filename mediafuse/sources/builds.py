"""Building the bundled id index: reading dumps, falling back to a cached extract, and writing guarded artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mediafuse.operators.crosswalk import MIN_INPUT, guarded

#: An entry of a dump of catalogue records. Fixed value.
ENTRY = "sources array<string>, title string, type string, episodes long, animeSeason struct<season:string,year:int>, picture string, score struct<arithmeticMean:double>"


def dump_entries(lines: DataFrame, least: int = MIN_INPUT, line: str = "value") -> DataFrame:
    """The entries of a dump of one JSON document a line. The line that describes the dump names no sources and is left out, as are lines that do not parse."""
    parsed = lines.select(F.from_json(line, ENTRY).alias("e")).where("e.sources is not null").select("e.*")
    return guarded(parsed, least, "dump")


def dump_header(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """What a dump says of itself: the line without sources, by its own schema."""
    return lines.where(F.get_json_object(line, "$.sources").isNull()).select(F.from_json(line, schema).alias("h")).where("h is not null").select("h.*")


def id_pairs(document: DataFrame, payload: str = "value") -> DataFrame:
    """(mal, anilist, kitsu, anidb) from one JSON array of id objects."""
    each = document.select(F.explode(F.from_json(payload, "array<struct<mal_id:long,anilist_id:long,kitsu_id:long,anidb_id:long>>")).alias("p"))
    return each.select(*(F.col(f"p.{c}_id").alias(c) for c in ("mal", "anilist", "kitsu", "anidb"))).where("mal is not null")


def read_or_cached(spark: SparkSession, path: str, cached: str, schema: str) -> DataFrame:
    """The table at ``path``, or the cached extract if that cannot be read; an error if neither can."""
    from pyspark.errors import AnalysisException

    for place in (path, cached):
        try:
            return spark.read.schema(schema).json(place)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"neither {path} nor {cached} can be read")


def write_artifact(rows: DataFrame, path: str, sources: dict[str, str], least: int, what: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Writes rows, if there are enough, and beside them a line on what they were made of; gives that line.

    The rows are evaluated once: they are counted, and ``metrics`` (aggregates) taken, by the job that writes them into
    a draft, and the draft takes the place of what was there only if the count is right.
    """
    spark, seen, draft = rows.sparkSession, Observation(), f"{path}-draft-{uuid.uuid4().hex}"
    rows.observe(seen, F.count(F.lit(1)).alias("_rows"), *(m.alias(n) for n, m in (metrics or {}).items())).write.parquet(draft)
    told = seen.get
    n = told["_rows"]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if n < least:
        store.delete(hadoop(draft), True)
        raise ValueError(f"{what}: {n} rows, at least {least} are expected")
    store.mkdirs(hadoop(path))
    store.delete(hadoop(f"{path}/data"), True)
    if not store.rename(hadoop(draft), hadoop(f"{path}/data")):
        raise RuntimeError(f"{path}/data cannot be put in place")
    measured = {k: str(v) for k, v in told.items() if k != "_rows"}
    about = spark.createDataFrame([(what, n, sources, measured)], "name string, rows long, sources map<string,string>, metrics map<string,string>")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return about
