"""SentencePiece encoding by forward-filtering and backward-sampling, and decoding.

The lattice of a text has an edge for every piece at every place.  Pieces keep
to word borders, so the lattice falls apart into those of its chunks (a word
with the spaces before it, or a line feed) and a sample of the text is a
sample of each chunk.  The distinct chunks of a slice of rows go into a trie,
whose nodes get forward sums once per shared prefix; the backward step then
draws the last piece of all occurrences at once, then the piece before, and so
on up the trie.

Draws are a hash of (seed, row key, number of the chunk, number of the step),
with probabilities rounded to 26 bits, so a row gets the same segmentation on
any cluster and in any partition.  Decoding joins the pieces' bytes and gives
the text back exactly: a character without a piece is spelled in byte pieces,
and so is a literal U+2581.

Null texts have null pieces; empty texts have none; rows with equal key and
text get equal pieces.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import body_sizes, mixed, slices
from sluice.llm.lattice import TALL, PieceTable, Trie, deepened, endings
from sluice.llm.pieces import Pieces

_CHUNK = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
_GRAIN = 2**26
SLICE = 1_000_000


class Lattices:
    """Forward-filtered lattices of distinct strings.

    ``ends[i]`` is the last state of string i.  Edge e of state s ends there;
    ``cum[e]`` is s plus the probability of the state's edges up to e, so one
    search over ``cum`` draws from any state.  The edge leads back to state
    ``before[e]`` (-1: the start) and stands for ``width[e]`` ids from
    ``flat[first[e]]`` on.
    """

    def __init__(self, strings: list[str], table: PieceTable, alpha: float):
        pieces = table.pieces
        short = np.array([len(s) <= TALL for s in strings], bool)
        trie = Trie([s for s in strings if len(s) <= TALL], table)
        parts: list[tuple[np.ndarray, ...]] = []
        forward, sums = np.zeros(1), np.zeros((1, 0))
        number, numbers = np.full(1, -1, np.int32), np.zeros((1, 0), np.int32)
        score = alpha * table.score
        for level in trie.levels():
            sums, numbers = deepened(sums, forward, level.parent, pieces.longest), deepened(numbers, number, level.parent, pieces.longest)
            edge = level.piece >= 0
            weight = np.where(edge, sums + score[level.piece], -np.inf)
            ids = np.where(edge, table.ids[level.piece], np.int32(-1))
            spelled = np.flatnonzero(~table.known[level.char])
            if len(spelled):
                raw = [chr(c).encode("utf-8", "surrogateescape") for c in level.char[spelled].tolist()]
                weight[spelled, 0] = sums[spelled, 0] + alpha * pieces.byte_score * np.array([len(x) for x in raw])
                ids[spelled, 0] = -1 - level.char[spelled]  # below -1: the bytes of a character
                edge[spelled, 0] = True
            top = weight.max(axis=1)
            share = np.exp(weight - top[:, None]).cumsum(axis=1)
            forward = top + np.log(share[:, -1])
            number = level.first + np.arange(len(level.char), dtype=np.int32)
            share /= share[:, -1:]
            cum = number[:, None] + np.round(share * _GRAIN) / _GRAIN
            parts.append((cum[edge], numbers[edge], ids[edge].astype(np.int32)))
        self.ends = np.empty(len(strings), np.int64)
        self.ends[short] = trie.ends
        states = trie.nodes
        for i in np.flatnonzero(~short).tolist():
            parts.append(self._tall(strings[i], states, alpha, pieces))
            states += len(strings[i])
            self.ends[i] = states - 1
        empty = (np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.cum, self.before, ids = (np.concatenate(x) for x in zip(empty, *parts))
        spelled = np.flatnonzero(ids < 0)
        raw = [chr(-1 - c).encode("utf-8", "surrogateescape") for c in ids[spelled].tolist()]
        self.width = np.ones(len(ids), np.int32)
        self.width[spelled] = [len(x) for x in raw]
        self.first = (np.cumsum(self.width) - self.width).astype(np.int32)
        self.flat = np.repeat(ids, self.width).astype(np.int32)
        spots = np.repeat(self.first[spelled], self.width[spelled]) + np.concatenate([np.arange(len(x)) for x in raw] or [np.zeros(0, np.int64)])
        self.flat[spots] = np.array(pieces.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]

    @staticmethod
    def _tall(word: str, base: int, alpha: float, pieces: Pieces) -> tuple[np.ndarray, ...]:
        """Edges of one long string, character by character."""
        forward, cum, before, ids = [0.0], [], [], []
        for end in range(1, len(word) + 1):
            edges = [(forward[start] + alpha * s, start, found) for start, s, found in endings(word, end, pieces)]
            top = max(e[0] for e in edges)
            total = sum(math.exp(e[0] - top) for e in edges)
            forward.append(top + math.log(total))
            run = 0.0
            for weight, start, found in edges:
                run += math.exp(weight - top) / total
                cum.append(base + end - 1 + round(min(run, 1.0) * _GRAIN) / _GRAIN)
                before.append(base + start - 1 if start else -1)
                ids.append(found[0] if word[start:end] in pieces.ids else -1 - ord(word[start]))
            cum[-1] = base + end
        return np.array(cum), np.array(before, np.int32), np.array(ids, np.int64)


def draws(keys: np.ndarray, chunk: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1), odd multiples of half a grain."""
    x = mixed(keys + chunk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03) & (2**64 - 1)))
    return ((x >> np.uint64(38)).astype(np.float64) + 0.5) / _GRAIN


def sample_rows(table: PieceTable, alpha: float, seeds: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pieces one after the other, and the number of pieces of each row."""
    found = [_CHUNK.findall(b) for b in bodies]
    per_row = np.array([len(x) for x in found], dtype=np.int64)
    n = int(per_row.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(bodies), np.int64)
    chunks = [c for x in found for c in x]
    del found
    index = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
    which = np.fromiter(map(index.__getitem__, chunks), np.int32, n)
    lattices = Lattices([c.decode("utf-8", "surrogateescape") for c in index], table, alpha)
    del chunks, index
    state = lattices.ends[which]
    cum, before, width = lattices.cum, lattices.before, lattices.width
    row = np.repeat(np.arange(len(bodies)), per_row)
    number = np.arange(n) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    keys = seeds.astype(np.uint64)[row]
    active, steps = np.arange(n), []
    while len(active):
        u = draws(keys[active], number[active], len(steps))
        edge = np.searchsorted(cum, state + u, side="right")
        steps.append((active, edge))
        state = before[edge]
        going = state >= 0
        active, state = active[going], state[going]
    taken = np.bincount(np.concatenate([a for a, _ in steps]), minlength=n)
    last = np.cumsum(taken) - 1
    edges = np.empty(int(taken.sum()), np.int64)
    for t, (a, e) in enumerate(steps):
        edges[last[a] - t] = e
    del steps
    wide = width[edges].astype(np.int64)
    ends = np.cumsum(wide)
    ids = lattices.flat[np.arange(int(ends[-1])) + np.repeat(lattices.first[edges] - (ends - wide), wide)]
    per_chunk = np.add.reduceat(wide, last - taken + 1)
    return ids, np.bincount(row, weights=per_chunk, minlength=len(bodies)).astype(np.int64)


def encode_sampled(
    docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", seed: int = 7, alpha: float = 1.0, ids: str = "piece_ids"
) -> DataFrame:
    """The rows of ``docs`` with a column of sampled piece ids (``array<int>``) at the end, in place of one of that name.

    ``alpha`` flattens (below 1) or sharpens the distribution over segmentations.
    """
    names = [c for c in docs.columns if c != ids]
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64(F.lit(seed), docs[key]).alias("seed_"), docs[text].cast("binary").alias("body_"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces.plain())
    n = len(names)

    def encode(batches):
        table = PieceTable(Pieces(*shared.value))
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(n + 1)), SLICE):
                part = batch.slice(a, b - a)
                bodies = part.column(n + 1).to_pylist()
                seeds = part.column(n).to_numpy(zero_copy_only=False).view(np.uint64)
                flat, sizes = sample_rows(table, alpha, seeds, [x or b"" for x in bodies])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = pa.array([x is None for x in bodies], pa.bool_())
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=missing)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], column], names=[*[f"c{i}" for i in range(n)], "ids"])
                del flat, column
                pa.default_memory_pool().release_unused()

    kinds = [*rows.schema.fields[:n]]
    made = rows.mapInArrow(encode, ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)], "ids array<int>"]))
    return made.toDF(*names, ids)


def decode_pieces(rows: DataFrame, pieces: Pieces, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """The rows with the text their pieces stand for as a last column; null pieces give null."""
    names = [c for c in rows.columns if c != text]
    numbered = rows.select(*[rows[c].alias(f"c{i}") for i, c in enumerate(names)], rows[ids].alias("ids_"))
    shared = rows.sparkSession.sparkContext.broadcast(pieces.surface)
    n = len(names)

    def decode(batches):
        surface = shared.value.__getitem__
        for batch in batches:
            for a, b in slices(body_sizes_of_lists(batch.column(n))):
                part = batch.slice(a, b - a)
                column = part.column(n)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                out, at = [], 0
                for size in column.value_lengths().to_pylist():
                    out.append(None if size is None else b"".join(map(surface, flat[at : at + size].tolist())))
                    at += size or 0
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(out, pa.binary())], names=[*[f"c{i}" for i in range(n)], "body"])

    kinds = numbered.schema.fields[:n]
    made = numbered.mapInArrow(decode, ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)], "body binary"]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("body").cast("string").alias(text))


def body_sizes_of_lists(column: pa.Array) -> np.ndarray:
    """Bytes of each list's ids, as a measure for slices."""
    import pyarrow.compute as pc

    return 4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
