"""Helpers shared by the training-data operators.

Every operator takes a frame and the names of its key and text columns, reads
only those, and ignores further columns, whatever they are called.  Per-row
Python sees Arrow batches of (key, UTF-8 bytes) and never a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sluice.semantics import scratch_path

#: Bytes of text that are worked on at once inside a task.
SLICE_BYTES = 4_000_000


#: Bytes of a batch that Spark hands to a task's Python at once.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, so that long texts do not fill the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the UTF-8 bytes of the text (null stays null)."""
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))


def key_type(df: DataFrame, column: str = "key"):
    return df.schema[column].dataType


def schema_with_key(df: DataFrame, name: str, more: str) -> StructType:
    """``name`` with the type of the frame's key, then the columns of a DDL string."""
    rest = StructType.fromDDL(more)
    return StructType([StructField(name, key_type(df)), *rest.fields])


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is a range by itself."""
    start = total = 0
    i = -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def body_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def translation(keep: Iterable[int]) -> bytes:
    """A byte table that lower-cases A-Z and turns every byte not in ``keep`` into a space."""
    kept = set(keep)
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in kept else 32 for b in lower)


#: ASCII letters (lower-cased) and everything outside ASCII.
LETTERS = translation([*range(97, 123), *range(128, 256)])
#: ASCII letters (lower-cased), digits and everything outside ASCII.
ALPHANUMERIC = translation([*range(48, 58), *range(97, 123), *range(128, 256)])
