"""JSON arrays read by byte range.

A file that is one array of objects has no line by which it could be split, and
a reader of whole files gives it to one task.  Here the text reader splits it at
closing braces, so each task gets a block of the file, beginning after a brace
somewhere, perhaps inside a string.  The first pass reduces every block to three
numbers: whether it has an odd number of quotes that are not escaped, and how
much deeper it ends than it begins, for either case of its beginning.  Running
sums over the blocks of a file give the state in which each block begins.  In
the second pass every block is cut into its objects; what is left of an object
at its ends is put together with that of its neighbours.  Both passes are
array operations on bytes.

A file may also be one object.  Anything else, or a file that ends too early,
ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.semantics import scratch_path, travels

travels(__name__)

#: Blocks whose states are sent to all tasks, 100 bytes each; beyond that they are joined by a shuffle.
SENT = 100_000

_QUOTE, _SLASH, _OPEN, _CLOSE = 34, 92, (91, 123), (93, 125)
#: By byte: how much deeper it leads outside of strings, and whether it may stand between objects.
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)], _STEP[list(_CLOSE)] = 1, -1
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(b"\xef\xbb\xbf \t\r\n,[]}")] = True


def quotes(text: np.ndarray) -> np.ndarray:
    """Marks of quotes that no backslash escapes."""
    found = text == _QUOTE
    at = np.flatnonzero(found)
    if len(at) and (text == _SLASH).any():
        places = np.arange(len(text))
        last = np.maximum.accumulate(np.where(text != _SLASH, places, -1))
        run = np.where(at > 0, at - 1 - last[at - 1], 0)
        found[at[run % 2 == 1]] = False
    return found


def within(text: np.ndarray, inside: bool) -> np.ndarray:
    """Marks of bytes in strings (of opening quotes too)."""
    # parity survives the wrap-around of a byte
    return ((np.cumsum(quotes(text), dtype=np.uint8) & 1) == 1) ^ inside


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[str, int], bytes]]:
    """First row, block and text of a batch, block by block; the reader took the braces away."""
    files, starts, lines = (batch.column(i) for i in range(3))
    n = len(lines)
    if not n:
        return
    other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
    bounds = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for at, end in zip(bounds, bounds[1:]):
        one = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), lines[at:end])
        yield at, (files[at].as_py(), starts[at].as_py()), pc.binary_join(one, pa.scalar(b"}", lines.type))[0].as_py() + b"}"


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, first, odd, deeper = None, 0, 0, [0, 0]

    def done():
        return pa.RecordBatch.from_pylist([{"file": block[0], "start": block[1], "first": first, "odd": odd, "out": deeper[0], "in": deeper[1]}])

    for batch in batches:
        for _, own, raw in _runs(batch):
            if own != block:
                if block is not None:
                    yield done()
                block, odd, deeper = own, 0, [0, 0]
                first = int(next(iter(raw.lstrip(b"\xef\xbb\xbf \t\r\n")), 0))
            text = np.frombuffer(raw, np.uint8)
            inside, change = within(text, odd == 1), _STEP[text]
            quoted = int((change * inside).sum(dtype=np.int64))
            deeper[0] += int(change.sum(dtype=np.int64)) - quoted
            deeper[1] += quoted
            odd = int(inside[-1])
    if block is not None:
        yield done()


class Cutter:
    """Cuts one block into objects; ``open_`` holds the bytes of an object that has begun."""

    def __init__(self, inside: bool, depth: int, base: int):
        self.inside, self.depth, self.base = inside, depth, base
        # the block may begin within an object
        self.open_: list[bytes] | None = [] if inside or depth > base else None
        self.head = self.open_ is not None

    def cut(self, raw: bytes) -> tuple[list[tuple[str, bytes]], pa.Array]:
        """What ends an object that had begun, and the objects that lie in the text."""
        text = np.frombuffer(raw, np.uint8)
        inside = within(text, self.inside)
        change = _STEP[text] * ~inside
        # few bytes change the depth: begins and ends are looked for among them
        places = np.flatnonzero(change)
        change, sign = change[places], text[places]
        depth = self.depth + np.cumsum(change, dtype=np.int64)
        begins = places[(sign == _OPEN[1]) & (depth == self.base + 1)]
        ends = places[(sign == _CLOSE[1]) & (depth == self.base)]
        self.inside, self.depth = bool(inside[-1]), int(depth[-1]) if len(depth) else self.depth
        parts, at, stop = [], 0, len(text)
        if self.open_ is not None:
            if not len(ends):
                self.open_.append(raw)
                return parts, pa.array([], pa.binary())
            at, ends = int(ends[0]) + 1, ends[1:]
            self.open_.append(raw[:at])
            parts.append(("head" if self.head else "whole", b"".join(self.open_)))
            self.open_, self.head = None, False
        if len(begins) > len(ends):
            stop, begins = int(begins[-1]), begins[:-1]
            self.open_ = [raw[stop:]]
        sound = len(begins) == len(ends) and (begins < ends).all() and (ends[:-1] < begins[1:]).all() and (not len(begins) or (begins[0] >= at and ends[-1] < stop))
        if not sound:
            raise ValueError(f"a JSON array of objects holds something else: {raw[at : at + 80]!r}")
        return parts, self.objects(text[at:stop], begins - at, ends - at)

    @staticmethod
    def objects(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
        edges = np.zeros(len(text) + 1, np.int8)
        edges[begins] += 1
        edges[ends + 1] -= 1
        own = np.cumsum(edges[:-1], dtype=np.int8) == 1
        between = text[~own]
        if not _BETWEEN[between].all():
            raise ValueError(f"a JSON array of objects holds something else: {between[:80].tobytes()!r}")
        offsets = np.concatenate([[0], np.cumsum(ends - begins + 1)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text[own])])

    def rest(self) -> list[tuple[str, bytes]]:
        return [("middle" if self.head else "tail", b"".join(self.open_))] if self.open_ else []


def _cutting(parts_only: bool):
    """Cuts lines into whole objects (their file is not named), or gives only parts of those that span blocks."""

    def rows(block: tuple[str, int], found: list[tuple[str, bytes]], objects: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        found = [(k, b) for k, b in found if (k == "whole") != parts_only]
        if found:
            kinds, bodies = zip(*found)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block[0]] * n), pa.array([block[1]] * n, pa.int64()), pa.array(kinds), pa.array(bodies, pa.binary())], ["file", "start", "kind", "body"]
            )
        if objects is not None and len(objects) and not parts_only:
            n = len(objects)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.repeat("whole", n), objects], ["file", "start", "kind", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cutter = None, None
        for batch in batches:
            for at, own, raw in _runs(batch):
                if own != block:
                    if block is not None:
                        yield from rows(block, cutter.rest())
                    block, cutter = own, Cutter(*[batch.column(c)[at].as_py() for c in ("inside", "depth", "base")])
                yield from rows(block, *cutter.cut(raw))
        if block is not None:
            yield from rows(block, cutter.rest())

    return cut


def blocks(lines: DataFrame) -> DataFrame:
    """(file, start, inside, depth, base): the state in which each block begins."""
    reduced = lines.mapInArrow(_reduce, "file string, start bigint, first bigint, odd bigint, out bigint, in bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    entered = reduced.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1).withColumn(
        "deeper", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))
    )
    state = entered.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0))).withColumn(
        "base", F.when(F.max(F.when(F.col("start") == 0, F.col("first"))).over(whole) == _OPEN[1], 0).otherwise(1)
    ).withColumn("last", F.sum("deeper").over(whole)).withColumn("odds", F.sum("odd").over(whole) % 2)
    # the brace that was put after the last line is one too many, unless the file ends with its object
    good = (F.col("odds") == 0) & ((F.col("last") == -1) | ((F.col("last") == 0) & (F.col("base") == 0)))
    checked = F.when(good, F.col("base")).otherwise(F.raise_error(F.concat(F.lit("not a whole JSON array: "), F.col("file"))).cast("int"))
    return state.select("file", "start", "inside", "depth", checked.alias("base"))


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """The objects of all arrays at a path, one text per row (column ``item``)."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )
    # a line per block, kept so that the files are not read again to make them
    kept = scratch_path(spark, "blocks")
    blocks(lines).write.parquet(kept)
    states = spark.read.parquet(kept)
    if states.count() <= SENT:
        # the side of the lines keeps its order
        joined = lines.join(F.broadcast(states), ["file", "start"])
    else:
        joined = lines.withColumn("at", F.monotonically_increasing_id()).join(states.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "at")
    joined = joined.select("file", "start", "line", "inside", "depth", "base")
    shape = "file string, start bigint, kind string, body binary"
    wholes, parts = joined.mapInArrow(_cutting(False), shape), joined.mapInArrow(_cutting(True), shape)
    place = F.when(F.col("kind") == "tail", 1).otherwise(0)
    number = F.sum(place).over(Window.partitionBy("file").orderBy("start", place).rowsBetween(Window.unboundedPreceding, 0))
    # an object that spans blocks begins with the one tail and ends with the next head
    joined_parts = parts.withColumn("n", number).groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "body"))).alias("p"))
    stitched = joined_parts.select(F.array_join(F.transform("p", lambda x: x["body"].cast("string")), "").alias("item"))
    return wholes.select(F.col("body").cast("string").alias("item")).unionByName(stitched)


def write_arrays(df: DataFrame, path: str) -> None:
    """The rows as JSON, one array per partition and file, one object per line."""

    def lines(batches):
        begun = False
        for batch in batches:
            items = batch.column(0)
            if not len(items):
                continue
            out = pc.binary_join_element_wise(pa.scalar(",", items.type), items, pa.scalar("", items.type))
            if not begun:
                out, begun = pa.concat_arrays([pa.array(["[" + items[0].as_py()], items.type), out[1:]]), True
            yield pa.RecordBatch.from_arrays([out], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], ["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(lines, "value string").write.text(path)
