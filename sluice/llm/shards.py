"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly over memory-sized buckets by a seeded
hash of their key.  Pass two holds one bucket at a time, orders it by content
(so that arrival order does not matter), shuffles it by Fisher-Yates with a
generator seeded by (seed, bucket), and deals the records out: the buckets
stand one after the other, and the record at place g of that order is in
shard g mod n at slot g div n.  So shard sizes in rows differ by one at most,
slots have no gaps, and a shard is itself in random order.

Keys that many rows share (null keys too) would overfill a bucket.  Those with
more rows than a quarter of a bucket are found first and scattered by row
number as well; there are at most four times as many of them as buckets.

The number of buckets follows from the measured size of the table.  Null texts
have no bytes; repeated rows are records of their own; an empty table gives
empty shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm.common import saved

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 24 << 20
#: Buckets whose rows are counted up together.
BLOCK_BUCKETS = 1000


def size_of(text) -> F.Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A seeded permutation: each place from the last swaps with a random earlier one or itself."""
    order = np.arange(n)
    picks = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 0, -1)).tolist()
    items = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), picks):
        items[i], items[j] = items[j], items[i]
    return np.array(items, np.int64)


def starts_of(scattered: DataFrame) -> DataFrame:
    """bucket_, before_ (rows in the buckets before it); only blocks of buckets are summed in one task."""
    counts = scattered.groupBy("bucket_").count().withColumn("block_", F.floor(F.col("bucket_") / F.lit(BLOCK_BUCKETS)))
    inside = Window.partitionBy("block_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = counts.groupBy("block_").agg(F.sum("count").alias("rows_"))
    earlier = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("block_", (F.sum("rows_").over(earlier) - F.col("rows_")).alias("first_"))
    placed = counts.withColumn("inside_", F.sum("count").over(inside) - F.col("count")).join(blocks, "block_")
    return placed.select("bucket_", (F.col("first_") + F.col("inside_")).alias("before_"))


def shuffle_into_shards(
    docs: DataFrame, shards: int = 8, seed: int = 11, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Whole records with two more columns, ``shard`` and ``slot`` (in place of columns of these names)."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    rows, total = plain.agg(F.count(F.lit(1)), F.sum(size_of(F.col(t)))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    crowd = max(1000, rows // buckets // 4)
    hot = plain.groupBy(F.col(k).alias("hot_key")).count().filter(F.col("count") > crowd).select("hot_key", F.lit(True).alias("hot_"))
    own = F.pmod(F.xxhash64(F.lit(seed), F.col(k)), F.lit(buckets)).cast("int")
    if hot.isEmpty():
        scattered = plain.withColumn("bucket_", own)
    else:
        spread = F.pmod(F.xxhash64(F.lit(seed), F.col("row_")), F.lit(buckets)).cast("int")
        numbered = plain.withColumn("row_", F.monotonically_increasing_id())
        marked = numbered.join(F.broadcast(hot), F.col(k).eqNullSafe(F.col("hot_key")), "left")  # at most 4 * buckets keys
        # row numbers are given once, so what is counted below is what is dealt out
        scattered = saved(marked.select(*plain.columns, F.when(F.col("hot_"), spread).otherwise(own).alias("bucket_")), "scattered")
    by_rank = [F.col(k), F.xxhash64(t), F.octet_length(t)]
    # a row before each bucket's records says how many rows stand in the buckets before it
    arranged = scattered.unionByName(starts_of(scattered), allowMissingColumns=True)
    arranged = arranged.repartitionById(buckets, "bucket_").sortWithinPartitions("bucket_", F.col("before_").isNull(), *by_rank)
    n = len(names)

    def deal(batches):
        held, bucket, start = [], None, 0

        def dealt():
            whole = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(whole.num_rows, seed, bucket)
            place = start + np.arange(whole.num_rows)
            out = whole.select(list(range(n))).take(pa.array(order))
            out = out.append_column("shard", pa.array(place % shards, pa.int32())).append_column("slot", pa.array(place // shards, pa.int64()))
            yield from out.to_batches(max_chunksize=5000)

        for batch in batches:
            marks = batch.column(n).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(edges, edges[1:]):
                if held and marks[a] != bucket:
                    yield from dealt()
                    held = []
                if b > a and batch.column(n + 1)[a].is_valid:
                    bucket, start, a = int(marks[a]), batch.column(n + 1)[a].as_py(), a + 1
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from dealt()

    kinds = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], "shard int", "slot bigint"])
    return arranged.mapInArrow(deal, kinds).toDF(*names, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a task are in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
