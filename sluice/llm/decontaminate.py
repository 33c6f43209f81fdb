"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of rows with a few megabytes of text.  Its index is built
over the word numbers of the shard: only benchmark words have a number, and
only stretches long enough to hold a window of them are indexed, since nothing
else can match.  The index is the Burrows-Wheeler transform of the stretches
as a wavelet matrix, plus every eighth suffix position.  All windows of the
benchmark are searched backward at once; occurrences are located by walking to
a sampled position; hit words merge into spans.

ASCII letters are lower-cased; words are maximal runs of ASCII letters, digits
and characters outside ASCII.  A window is ``window`` consecutive words of an
item; an item with fewer, but not none, is one window.  A word of a document is
hit if any occurrence of a window covers it.

A row is judged in the task that reads it: no shuffle.  The benchmark is split
by item into blocks of measured size; tasks load one block after the other.
Null and empty texts have no words and no hits, null items no windows; an item
without id has the id ''.  Repeated rows are judged alike; an empty benchmark
hits nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ALPHANUMERIC, body_sizes, keyed_text, schema_with_key, slices

WINDOW = 10
SHARD_BYTES = 8_000_000
BLOCK_BYTES = 16_000_000
_SAMPLE = 8


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(ALPHANUMERIC).split() if body else []


class Windows:
    """The distinct windows of a block of items, as word numbers, by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {item: n for n, item in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, body in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(body)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[start : start + window]), set()).add(number[item])
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # patterns, owner starts, owners
        for length in sorted({len(w) for w in owners}):
            own = [(w, sorted(o)) for w, o in owners.items() if len(w) == length]
            self.groups.append((
                np.array([w for w, _ in own], np.int64), np.cumsum([0, *[len(o) for _, o in own]]), np.array([x for _, o in own for x in o], np.int64),
            ))
        self.shortest = min((len(w) for w in owners), default=0)


class WaveletMatrix:
    """Ranks in a sequence of numbers below 2**bits, for many questions at once."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(bit)])
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((level, bit, ones, zeros))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(place)
        for level, _, ones, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            place = np.where(one, zeros + ones[place], place - ones[place])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return place - start

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        start, symbol = np.zeros_like(place), np.zeros_like(place)
        for _, bit, ones, zeros in self.levels:
            one = bit[place]
            symbol = symbol << 1 | one
            place = np.where(one, zeros + ones[place], place - ones[place])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return symbol, place - start


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; zeros differ from each other (earlier ones are smaller)."""
    n = len(sequence)
    zero = sequence == 0
    rank = np.where(zero, np.cumsum(zero) - 1, sequence + int(zero.sum()))
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (int(following.max(initial=0)) + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Counts and places of patterns in a sequence of numbers in which 0 separates stretches."""

    def __init__(self, sequence: np.ndarray):
        self.n = len(sequence)
        top = int(sequence.max())
        order = suffix_order(sequence)
        transform = sequence[order - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 1))])
        self.wavelet = WaveletMatrix(transform, max(1, top.bit_length()))
        sampled = (order % _SAMPLE == 0) | (transform == 0)  # a walk never crosses a separator
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.positions = order[sampled]
        self.top = top

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the sorted suffixes that start with each pattern: from, to."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns <= self.top).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            low[alive] = self.smaller[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled[rows]
            out[todo[here]] = self.positions[self.sample_rank[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            symbol, rank = self.wavelet.symbol_and_rank(rows)
            rows = self.smaller[symbol] + rank
            steps += 1
        return out


def stretches(ids: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of numbered words inside a row, of ``shortest`` words or more, each followed by a 0; and where each number came from."""
    n = len(ids)
    edge = np.zeros(n + 1, bool)
    edge[ends] = edge[0] = True
    known = ids > 0
    start = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    stop = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = stop - start >= shortest
    start, size = start[long], (stop - start)[long]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = size + 1
    behind = np.cumsum(wide)
    origin = np.arange(int(behind[-1])) + np.repeat(start - (behind - wide), wide)
    sequence = ids[np.minimum(origin, n - 1)].astype(np.int64)
    sequence[behind - 1] = 0
    return sequence, origin


def shard_hits(bodies: list[bytes | None], blocks: Iterator[Windows]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words per row, a mark for every hit word of the shard, and the items found in each row."""
    found = [words_of(b) for b in bodies]
    per_row = np.array([len(x) for x in found], np.int64)
    words = [w for x in found for w in x]
    del found
    ends = np.cumsum(per_row)
    marks = np.zeros(len(words) + 1, np.int64)
    items: list[set[str]] = [set() for _ in bodies]
    for block in blocks:
        if not block.groups:
            continue
        ids = np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int32, len(words))
        sequence, origin = stretches(ids, ends, block.shortest)
        if not len(sequence):
            continue
        index = FMIndex(sequence)
        for patterns, owner_starts, owners in block.groups:
            low, high = index.search(patterns)
            size = high - low
            total = int(size.sum())
            if not total:
                continue
            pattern = np.repeat(np.arange(len(patterns)), size)
            rows = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
            word = origin[index.locate(rows)]
            np.add.at(marks, word, 1)
            np.add.at(marks, word + patterns.shape[1], -1)
            row = np.searchsorted(ends, word, side="right")
            pairs = np.unique(np.stack([row, pattern]), axis=1)
            for r, p in pairs.T.tolist():
                items[r].update(block.items[o] for o in owners[owner_starts[p] : owner_starts[p + 1]].tolist())
    return per_row, np.cumsum(marks[:-1]) > 0, items


def byte_spans(body: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """From the first to behind the last byte of each maximal run of hit words."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", body.translate(ALPHANUMERIC))]
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())]


def benchmark_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the items, each of about ``block_bytes`` of text at most."""
    items = keyed_text(benchmark, key, text).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("item"), "body")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    made = []
    for b in range(blocks):
        rows = items.filter(part == b).dropDuplicates().collect()  # one block, of bounded size
        made.append(context.broadcast([(r["item"], None if r["body"] is None else bytes(r["body"])) for r in rows]))
    return made


def loaded(blocks: list, window: int) -> Iterator[Windows]:
    """One block after the other; a single one is prepared once per task."""
    if len(blocks) == 1:
        yield from repeat(Windows(blocks[0].value, window))
    while True:
        for b in blocks:
            yield Windows(b.value, window)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (ids as strings, sorted), spans (byte ranges to remove)."""
    rows = keyed_text(docs, key, text)
    blocks = benchmark_blocks(benchmark, item, item_text)

    def judge(batches):
        prepared = loaded(blocks, window)
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(1)), SHARD_BYTES):
                bodies = batch.column(1).slice(a, b - a).to_pylist()
                per_row, hit, items = shard_hits(bodies, (next(prepared) for _ in blocks))
                starts = np.cumsum(per_row) - per_row
                n_hit, spans = [], []
                for body, s, n in zip(bodies, starts.tolist(), per_row.tolist()):
                    own = hit[s : s + n]
                    n_hit.append(int(own.sum()))
                    spans.append([{"begin": x, "end": y} for x, y in byte_spans(body, own)] if n_hit[-1] else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(per_row, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                    names=[key, "n_words", "n_hit", "items", "spans"],
                )

    return rows.mapInArrow(judge, schema_with_key(rows, key, "n_words bigint, n_hit bigint, items array<string>, spans array<struct<begin:int,end:int>>"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with the hit spans cut out of the text."""
    names = docs.columns
    n = len(names)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text].cast("binary").alias("body"))
    blocks = benchmark_blocks(benchmark, item, item_text)

    def clean(batches):
        prepared = loaded(blocks, window)
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(n)), SHARD_BYTES):
                part = batch.slice(a, b - a)
                bodies = part.column(n).to_pylist()
                per_row, hit, _ = shard_hits(bodies, (next(prepared) for _ in blocks))
                at = 0
                for i, size in enumerate(per_row.tolist()):
                    own = hit[at : at + size]
                    if own.any():
                        behind, kept = 0, []
                        for x, y in byte_spans(bodies[i], own):
                            kept.append(bodies[i][behind:x])
                            behind = y
                        bodies[i] = b"".join([*kept, bodies[i][behind:]])
                    at += size
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(bodies, pa.binary())], names=[*[f"c{i}" for i in range(n)], "body"])

    kinds = rows.schema.fields[:n]
    made = rows.mapInArrow(clean, ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)], "body binary"]))
    return made.select(*[(F.col("body").cast("string") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
