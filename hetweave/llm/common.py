"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.lineage import cut
from hetweave.operators.graph import connected_components

__all__ = ["add_column", "connected_components", "cut", "free_name", "numbered_copies", "pieces", "small_batches", "table", "text_buffer"]

ARROW_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark so that any path Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts: keep what one Arrow batch holds small, unless the user chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without a copy, and where each value starts.

    Nulls count as empty strings.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Cut a batch into runs of rows of at most so many bytes; a longer row is a run of its own."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


def add_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use yet (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def numbered_copies(counted: DataFrame, copies: str, number: str, step: int = 4096) -> DataFrame:
    """Each row of a counted table as many times as `copies` says, numbered from 0.

    Rows with more than `step` copies are cut into runs of that many, which are spread over the
    tasks before they are written out, so no task makes all the copies of one row.
    """
    few = counted.where(F.col(copies) <= step).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    many = counted.where(F.col(copies) > step).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step).cast("long"))))
    many = many.repartition(*[F.col(c) for c in counted.columns], F.col(number))
    last = F.least(F.col(copies), (F.col(number) + 1) * step) - 1
    many = many.withColumn(number, F.explode(F.sequence(F.col(number) * step, last)))
    return few.unionByName(many).drop(copies)
