"""What the operators share: reading tables, staged tables in the shared folder, and splitting Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spindlegraph.components import written


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder of spark.checkpoint.dir and read it back: its lineage ends there and outlives lost executors."""
    return written(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = (2 << 20) - 2, max_rows: int = 4095) -> Iterator[pa.RecordBatch]:
    """Slices of at most max_rows rows and, unless one text alone is longer, max_bytes of text; nulls in the column become empty texts."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        texts = batch.column(k)
        if texts.null_count:
            texts = texts.fill_null("")
            batch = batch.set_column(k, batch.schema.field(k), texts)
        ends = np.cumsum(texts.nbytes and np.asarray(pc.binary_length(texts), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + max_bytes, side="right")), at + 1), at + max_rows)
            yield batch.slice(at, to - at)
            at = to
