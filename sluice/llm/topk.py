"""Exact top-k search by tiled matrix products.

Components become floor(256 * x) with x as double, so scores are integer inner
products and exact: a tile is multiplied in single precision where every sum
stays below 2^24, in double precision below 2^53, and in 64-bit integers
beyond.  A score that might not fit a long ends the job with an error.

Vectors are packed into blocks, one row of bytes each.  Query blocks are dealt
out over H groups and candidate blocks over G; cell (h, g) is a partition of
its own that holds one group of query blocks, streams the candidate blocks past
them, selects the best of every tile and keeps a running list per query.  The
lists of the G cells of a query block are merged in a tree, FAN at a time.
Neither the queries nor the lists are ever in one place.

Every list is one longer than asked for.  The query's own row is a candidate
like any other; an entry with the query's id and its product with itself is
taken out once at the end.  So repeated rows and repeated ids need no row
numbers: each row whose id is chosen is a query, and every other row, one of
the same id too, is a candidate.

Vectors that are null or hold a null or non-finite component take no part.
Ties go to the smaller id; a row without id comes after the others and is never
a query.  An empty vector has score 0 with all; of vectors of different length
the common leading components count.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import saved

#: Rows of a query block and of a candidate block, and most components of a block.
QUERY_ROWS, ROWS, COMPONENTS = 1024, 8192, 1 << 20
#: Query blocks that a cell holds, candidate blocks that it streams in a large search.
HELD, STREAMED = 32, 128
#: Lists that are merged at once.
FAN = 32

BLOCK = "place bigint, ids binary, nulls int, width int, kind string, body binary"
LISTS = "place bigint, part int, ids binary, nulls int, own binary, lists binary"
ENTRY = [("score", "<i8"), ("rest", "u1"), ("id", "<i8")]


def finite(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def matrix(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """floor(256 * x) of vectors that stand one after the other; shorter ones are filled up with zeros."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat.astype(np.float64) * 256.0)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ArithmeticError("a component is too large for integer scores")
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = scaled.astype(np.int64)
    return out


def block_of(place: int, keys: pa.Array, vectors: np.ndarray) -> dict:
    """One packed block; rows stand by id, those without one last."""
    missing = np.asarray(keys.is_null())
    ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((ids, missing))
    most = int(np.abs(vectors).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return {
        "place": place, "ids": ids[order].tobytes(), "nulls": int(missing.sum()), "width": vectors.shape[1], "kind": kind,
        "body": vectors[order].astype(kind).tobytes(),
    }


def packed(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors, packed where the rows are and written once."""
    schema = pa.schema([("place", pa.int64()), ("ids", pa.binary()), ("nulls", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("body", pa.binary())])

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        held, wide = [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column(1).combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_pylist([block_of(first + made, table.column(0).combine_chunks().cast(pa.int64()), matrix(values, lengths))], schema)

        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            at = 0
            while at < batch.num_rows:
                have = sum(b.num_rows for b in held)
                widest = np.maximum.accumulate(np.maximum(lengths[at:], max(wide, 1)))
                fits = (np.arange(1, len(widest) + 1) + have) * widest <= COMPONENTS
                fit = min(rows - have, int(np.argmin(fits)) if not fits.all() else len(fits))
                if fit <= 0 and held:
                    yield block()
                    made, held, wide = made + 1, [], 0
                    continue
                fit = max(fit, 1)
                held.append(batch.slice(at, fit))
                wide = max(wide, int(lengths[at : at + fit].max(initial=0)))
                at += fit
        if held:
            yield block()

    narrow = vectors.filter(finite(F.col(vector))).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"))
    return narrow.mapInArrow(pack, BLOCK)


def loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids, marks of missing ids, vectors and their largest component."""
    ids = np.frombuffer(row["ids"], "<i8")
    rest = (np.arange(len(ids)) >= len(ids) - row["nulls"]).astype(np.uint8)
    vectors = np.frombuffer(row["body"], row["kind"]).reshape(len(ids), row["width"])
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
    return ids, rest, vectors, most


def products(q: np.ndarray, most_q: int, c: np.ndarray, most_c: int) -> np.ndarray:
    """Exact integer products of two blocks, in the fastest type that holds them."""
    width = min(q.shape[1], c.shape[1])
    bound = width * most_q * most_c
    if bound >= 1 << 63:
        raise ArithmeticError("a score may not fit a long")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return q[:, :width].astype(kind) @ c[:, :width].astype(kind).T


def empty_lists(n: int, k: int) -> np.ndarray:
    out = np.zeros((n, k), ENTRY)
    out["rest"], out["score"] = 2, np.iinfo(np.int64).min
    return out


def best(entries: np.ndarray, k: int) -> np.ndarray:
    """The first k entries of every row by (score, missing id, id); places without entry stand last."""
    order = np.lexsort((entries["id"], entries["rest"], ~entries["score"]), axis=1)[:, :k]
    return np.take_along_axis(entries, order, axis=1)


def best_of_tile(scores: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int) -> np.ndarray:
    """Partial selection: all scores down to the k-th, ties among them by place, since rows stand by id."""
    n, width = scores.shape
    if width <= k:
        out = empty_lists(n, k)
        out["score"][:, :width], out["rest"][:, :width], out["id"][:, :width] = scores.astype(np.int64), rest, ids
        return best(out, k)
    least = np.partition(scores, width - k, axis=1)[:, width - k]
    row, column = np.nonzero(scores >= least[:, None])
    found = scores[row, column].astype(np.int64)
    order = np.lexsort((column, ~found, row))
    row, column, found = row[order], column[order], found[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    out = empty_lists(n, k)
    at = row[top], rank[top]
    out["score"][at], out["rest"][at], out["id"][at] = found[top], rest[column[top]], ids[column[top]]
    return out


def searched(queries: DataFrame, candidates: DataFrame, k: int, held: int, streamed: int, fan: int) -> DataFrame:
    """One row of lists per query block: the best k entries of every query."""
    spark = queries.sparkSession
    n_queries, n_candidates = queries.count(), candidates.count()
    groups = max(1, math.ceil(n_queries / held))
    spread = max(1, min(n_candidates, max(math.ceil(n_candidates / streamed), math.ceil(2 * spark.sparkContext.defaultParallelism / groups))))
    dealt = [
        side.withColumn("side", F.lit(i)).withColumn("own_", F.pmod(F.hash("place"), F.lit(n)).cast("int"))
        .withColumn("other_", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        .withColumn("cell", (F.col("own_") * spread + F.col("other_") if i == 0 else F.col("other_") * spread + F.col("own_")).cast("int"))
        for i, (side, n, m) in enumerate(((queries, groups, spread), (candidates, spread, groups)))
    ]
    cells = dealt[0].unionByName(dealt[1]).select("cell", "side", "place", "ids", "nulls", "width", "kind", "body")
    cells = cells.repartitionById(groups * spread, "cell").sortWithinPartitions("cell", "side", "place")
    schema = pa.schema([("place", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("nulls", pa.int32()), ("own", pa.binary()), ("lists", pa.binary())])

    def multiply(batches):
        cell, blocks, lists = None, [], []

        def done():
            for (row, (_, _, vectors, most)), found in zip(blocks, lists):
                own = np.array([products(v[None], most, v[None], most)[0, 0] for v in vectors], np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "place": row["place"], "part": cell % spread, "ids": row["ids"], "nulls": row["nulls"], "own": own.tobytes(), "lists": found.tobytes(),
                }], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from done()
                    cell, blocks, lists = row["cell"], [], []
                if row["side"] == 0:
                    blocks.append((row, loaded(row)))
                    lists.append(empty_lists(len(row["ids"]) // 8, k))
                    continue
                ids, rest, vectors, most = loaded(row)
                for i, (_, (_, _, q, most_q)) in enumerate(blocks):
                    tile = best_of_tile(products(q, most_q, vectors, most), ids, rest, k)
                    lists[i] = best(np.concatenate([lists[i], tile], axis=1), k)
        yield from done()

    def merge(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        every = [np.frombuffer(x.as_py(), ENTRY).reshape(-1, k) for x in table.column("lists")]
        return pa.Table.from_pylist([first | {"lists": best(np.concatenate(every, axis=1), k).tobytes()}], schema)

    lists, parts = cells.mapInArrow(multiply, LISTS), spread
    while parts > 1:
        parts = math.ceil(parts / fan)
        lists = lists.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("place", "part").applyInArrow(merge, LISTS)
    return lists


def top_k(
    vectors: DataFrame, queries: Column | str, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS,
    rows: int = ROWS, held: int = HELD, streamed: int = STREAMED, fan: int = FAN,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that ``queries`` chooses."""
    chosen = vectors.filter(queries).filter(F.col(key).isNotNull())
    parts = max(1, math.ceil(chosen.count() / query_rows))
    query_blocks = saved(packed(chosen.select(key, vector).repartition(parts), key, vector, query_rows), "query-blocks")
    candidate_blocks = saved(packed(vectors, key, vector, rows), "candidate-blocks")
    lists = searched(query_blocks, candidate_blocks, k + 1, held, streamed, fan)
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = np.frombuffer(row["lists"], ENTRY).reshape(-1, k + 1)
                ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["own"], "<i8")
                itself = (found["rest"] == 0) & (found["id"] == ids[:, None]) & (found["score"] == own[:, None])
                itself &= np.cumsum(itself, axis=1) == 1
                stays = (found["rest"] < 2) & ~itself
                rank = np.cumsum(stays, axis=1)
                stays &= rank <= k
                at = np.nonzero(stays)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at[0]]), pa.array(rank[at].astype(np.int32)), pa.array(found["id"][at], mask=found["rest"][at] == 1), pa.array(found["score"][at]),
                ], schema=schema)

    return lists.mapInArrow(unpack, "query_id bigint, rank int, vec_id bigint, score bigint")
