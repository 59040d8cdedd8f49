"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.storage import fresh_path, shared_dir, stored

__all__ = ["WORD", "documents", "fresh_path", "freed", "map_arrow", "shared_dir", "small_batches", "stored", "table", "tokenizer_path"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, where a session leaves Spark's number for short rows: texts are long.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under the names doc_id and text: other columns, whatever
    they are called, can't clash with an operator's own."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches, after the last of which the worker's free memory goes back: workers live on, and share an executor."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not a GNU system
            pass


def _run(batches: Iterator[pa.RecordBatch], task, args: dict) -> Iterator[pa.RecordBatch]:
    yield from freed(task(batches, **args))


def map_arrow(df: DataFrame, task, schema: str, **args) -> DataFrame:
    """``mapInArrow`` of task(batches, **args), see freed()."""
    return df.mapInArrow(partial(_run, task=task, args=args), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; the folder can be set by PUBLIC_TOKENIZERS_DIR."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
