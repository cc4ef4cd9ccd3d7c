"""Main text of web pages: a bidirectional LSTM over the leaf blocks of a page keeps those of the article."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mediafuse.llm.block_labeller import Labeller, trained
from mediafuse.llm.columns import col
from mediafuse.llm.html_blocks import blocks

#: Pages that a task labels at a time.
PAGES_AT_ONCE = 128


def _extracted(model):
    labeller: Labeller = model.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                found = [blocks(h) if h else [] for h in part.column(part.num_columns - 1).to_pylist()]
                kept = [[b.text for b, p in zip(f, prob, strict=True) if p > 0.5] for f, prob in zip(found, labeller.predict(found), strict=True)]
                text = [" ".join(k) for k in kept]
                n = [np.array([len(x) for x in v], dtype=np.int64) for v in (text, found, kept)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), *map(pa.array, n)], names=[*part.schema.names[:-1], "text", "n_chars", "n_blocks", "n_kept"])
    return run


def extract(pages: DataFrame, model: Labeller | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of pages (default: all but html_col) with text, n_chars, n_blocks and n_kept.

    Null and empty pages and pages without article give empty text. Existing columns of the new names are
    replaced, others pass, whatever they are called; repeated rows give equal rows. Blocks stay in page order,
    each with single spaces, joined by one space; nothing is cut, and pages of any length are read whole.
    """
    new = ("text", "n_chars", "n_blocks", "n_kept")
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in new and c != html_col]
    rows = pages.select(*map(col, keep), col(html_col).cast("string").alias("\0html"))
    schema = StructType([*rows.schema.fields[:-1], StructField("text", StringType()), *(StructField(n, LongType()) for n in new[1:])])
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    return rows.mapInArrow(_extracted(shared), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
