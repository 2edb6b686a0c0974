"""What the text operators share: tables, splits, shared folders, batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.graph import materialize, scratch_path

#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def held_out(doc_id: Column, mod: int, rem: int) -> Column:
    """Rows that nothing is learned from. A null id belongs to no fold that may be learned from."""
    return F.coalesce(remainder(doc_id, mod) == rem, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return scratch_path(spark)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to a shared folder and read again: cuts lineage, and survives lost executors."""
    return materialize(df)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, so that long texts do not fill a worker. A bound that the session has set itself stays."""
    own = spark.conf.getAll
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{key}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def release() -> None:
    """Gives memory that this process has freed back to the machine, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _tidy(fn):
    def run(batches):
        yield from fn(batches)
        release()

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def filter_rows(docs: DataFrame, keep: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows whose text keep() accepts, with all their columns, whatever these are called. keep() builds its judge once a task."""

    def run(batches):
        judge = keep()
        for batch in batches:
            yield batch.filter(pa.array(judge(texts_of(batch, text_col)), pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z and nothing else. Text of single bytes takes the faster built-in, which changes nothing else there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column, between: str) -> Column:
    """The pieces of a text between runs of the characters ``between`` (a character class), which are the matches of its complement. Spark copies a text for every match it extracts, but cuts it in one pass."""
    return F.array_remove(F.split(text, f"[{between}]+"), "")
