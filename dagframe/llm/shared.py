"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where the session sets no bound of its own; a longer text makes a batch of its own.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes, so that neither side holds thousands of whole documents at once, and
    with free memory given back at the end of a task, as idle workers stay beside the next stage's."""
    if not df.sparkSession.conf.get(BATCH_SETTING, None):
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()

    return df.mapInArrow(tidy, schema)


def given_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", "local") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, a lost executor loses nothing,
    the work behind it runs once, and joins know its size before they are planned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/dagframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def released(*tables: DataFrame) -> None:
    """Deletes tables made by stored(), once nothing that is still to run reads them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

