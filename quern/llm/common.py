"""What the training-data operators share: shared storage, batching and ragged arrays.

Defined results that hold for every operator here unless its docstring says
otherwise: a null text is an empty text, extra columns of the input are ignored,
repeated rows are processed as rows of their own, an empty table gives an empty
result with the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch between the JVM and Python; documents may be long.
ARROW_ROWS = 1000
_written: list[tuple[SparkSession, str]] = []


def lean() -> None:
    """Gives back what a Python worker no longer needs; workers are reused and share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the Arrow batches of this session, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all executors are in this process (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"quern-shared-{os.getpid()}")
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    path = getattr(df, "quern_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner delete shuffle files of plans that are done with, before the next large shuffle."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    lean()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about limit characters each; a longer text is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[s:s+n], one after the other."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(total)
    return flat[at]


def fingerprint(col: Column, salt: int) -> Column:
    """A 64-bit hash; two of them with different salts name a text."""
    return F.xxhash64(col, F.lit(salt))


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
