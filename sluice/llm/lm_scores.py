"""Language-model scores by cross-entropy difference.

Two bigram models, one of a target and one of the background, share one
vocabulary and one method, and the background's counts are scaled to the
target's number of tokens, so the models differ in the text alone.  A row's
score is its mean loss per token under the target model less that under the
background model: the lower, the more like the target.

Counts cover every row, every target row and every word and pair, and stay
distributed tables that grow with the corpus.  Texts are read once and become
sequences of word numbers, in parts of bounded size.  The matrix of pair counts
is summed in blocks: a part sends to each cell of the matrix its pairs there,
sorted, as one compressed block; the cell adds its blocks up and answers each
with the sums in the order of its pairs, so that no pair travels back.  A word
with many tokens is spread over several cells.  The driver sees totals only.
Absolute discounting gives what is taken from the pairs of a word back to the
words' add-one shares, so both models sum to one.  ``least_word`` and
``least_pair`` leave out words (they become one unknown word) and pairs with a
smaller share of tokens, averaged over both corpora; by default nothing is left
out.

Words are maximal runs of ASCII letters, digits and characters outside ASCII,
lower-cased in ASCII, and are told apart by 64-bit hashes; a row begins with a
start mark.  Rows without words (null, empty) have null scores.  Without target
rows its model is uniform over words.  Repeated rows count and are scored
repeatedly; repeated target keys count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import ALPHANUMERIC, body_sizes, keyed_text, mixed, saved, schema_with_key, slices

#: Bytes of text whose pairs are counted, and whose rows are scored, together.
PART_BYTES = 16 << 20
#: Tokens whose pairs are summed together, on average.
CELL_TOKENS = 2_000_000
#: Words are numbered in this many groups, by frequency inside each.
NUMBER_GROUPS = 1024
#: Tokens that are scored at once inside a task.
SCORED_TOKENS = 500_000
DISCOUNT = 0.5
_UNKNOWN, _START = 0, 1
#: The row of a part that holds the hashes of its words.
_VOCABULARY = -1


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(ALPHANUMERIC).split() if body else []


class Places(dict):
    """Word to its place in the part's vocabulary, from 1 on in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self) + 1
        return place


def packed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: planes of zeros cost nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


@dataclass
class Rows:
    """``sequences`` (part, row, key, n_words, body: the places of its words; row -1: the part's word hashes) and ``hits`` (part, row, n_words: rows of the target), saved."""

    sequences: DataFrame
    hits: DataFrame


def marked(docs: DataFrame, target: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> Rows:
    """The texts as sequences, in parts of about ``part_bytes`` bytes of text, and which rows are of the target."""
    bodies = keyed_text(docs, key, text)
    schema = schema_with_key(bodies, "key", "part bigint, row int, n_words bigint, body binary")

    def dealt(batches):
        part, total, row, places, null = TaskContext.get().partitionId() << 32, 0, 0, Places(), None

        def batch_of(keys, rows, sizes, bodies):
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(np.full(len(rows), part)), pa.array(rows, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=schema.names
            )

        def vocabulary():
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in places), np.uint64, len(places))
            return batch_of(null, [_VOCABULARY], [len(places)], [hashes.tobytes()])

        for batch in batches:
            null = pa.nulls(1, batch.column(0).type)
            sizes = body_sizes(batch.column(1)).tolist()
            start = 0
            for i in range(len(sizes) + 1):
                full = i < len(sizes) and total and total + sizes[i] > part_bytes
                if (full or i == len(sizes)) and i > start:
                    found = [np.fromiter(map(places.__getitem__, words_of(b.as_py())), np.int32) for b in batch.column(1).slice(start, i - start)]
                    yield batch_of(batch.column(0).slice(start, i - start), np.arange(row, row + i - start), [len(x) for x in found], [packed(x) for x in found])
                    row, start = row + i - start, i
                if full:
                    yield vocabulary()
                    part, total, row, places = part + 1, 0, 0, Places()
                total += sizes[i] if i < len(sizes) else 0
        if row:
            yield vocabulary()

    sequences = saved(bodies.mapInArrow(dealt, schema), "sequences")
    chosen = target.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    hits = sequences.filter(F.col("row") > _VOCABULARY).join(chosen.hint("merge"), "key").select("part", "row", "n_words")
    return Rows(sequences, saved(hits, "hits"))


class Part:
    """A part's sequences: ``before`` and ``after`` (places of each word and of the one before it, 0: the start), row by row."""

    def __init__(self, rows: pa.Table):
        import pyarrow.compute as pc

        self.words = np.frombuffer(rows.filter(pc.equal(rows.column("row"), _VOCABULARY)).column("body")[0].as_py(), np.int64)
        self.rows = rows.filter(pc.greater(rows.column("row"), _VOCABULARY)).sort_by("row").combine_chunks()
        self.sizes = self.rows.column("n_words").to_numpy()
        ends = np.cumsum(self.sizes)
        self.after = np.empty(int(self.sizes.sum()), np.int32)
        for b, n, end in zip(self.rows.column("body"), self.sizes.tolist(), ends.tolist()):
            self.after[end - n : end] = unpacked(b.as_py(), n, np.int32)
        self.rows = self.rows.drop_columns(["part", "body"])
        self.before = np.empty_like(self.after)
        self.before[1:] = self.after[:-1]
        self.before[(ends - self.sizes)[self.sizes > 0]] = 0

    def hit(self, rows: pa.Table) -> np.ndarray:
        """Which words are of target rows."""
        return np.repeat(np.isin(self.rows.column("row").to_numpy(), rows.column("row").to_numpy()), self.sizes)

    def numbers(self, found: pa.Table, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of the word at each place, and its tokens in all rows."""
        number, tokens = np.zeros(len(self.words) + 1, np.int64), np.zeros(len(self.words) + 1, np.int64)
        number[0], tokens[0] = _START, starts
        place = found.column("place").to_numpy()
        number[place], tokens[place] = found.column("number").to_numpy(), found.column("every").to_numpy()
        return number, tokens

    def pairs(self, number: np.ndarray, tokens: np.ndarray, cells: int, hit: np.ndarray | None = None):
        """Distinct pairs of known words in order of cell and number: cell, pair of numbers, pair of places, count, and how many are hit (None without hits)."""
        # one array is sorted where it stands: both places and, in the last bit, whether the pair is hit
        x = self.before.astype(np.uint64)
        x <<= np.uint64(32)
        x |= self.after.view(np.uint32)
        x <<= np.uint64(1)
        if hit is not None:
            x |= hit
        unknown = number == _UNKNOWN
        if unknown.any():
            x = x[~(unknown[self.before] | unknown[self.after])]
        x.sort()
        first = runs(x >> np.uint64(1))
        place = (x[first] >> np.uint64(1)).astype(np.int64)
        count = np.diff(first, append=len(x))
        weight = None
        if hit is not None:
            x &= np.uint64(1)
            weight = np.add.reduceat(x, first).astype(np.int64) if len(first) else count
        del x, first
        cell, key = self._cells(place, number, tokens, cells)
        order = np.lexsort((key, cell))
        return cell[order], key[order], place[order], count[order], weight if weight is None else weight[order]

    @staticmethod
    def _cells(place: np.ndarray, number: np.ndarray, tokens: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = place >> 32, place & 0xFFFFFFFF
        lane = mixed(number[b])
        lane %= (tokens[a] // CELL_TOKENS + 1).astype(np.uint64)
        lane += mixed(number[a])
        lane = mixed(lane)
        lane %= np.uint64(cells)
        return lane.astype(np.int64), number[a] << 32 | number[b]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_keys)), bool), sorted_keys[1:] != sorted_keys[:-1]]))


def share(every: int, target: int):
    """Mean share of a count in both corpora (in the one that there is), from the counts."""
    known = [(i, n) for i, n in enumerate((every, target)) if n]
    return lambda *counts: sum(counts[i] / float(n) for i, n in known) / float(max(1, len(known)))


@dataclass
class Counts:
    """Both models' counts: ``words`` (number, every, target, and what is taken from its pairs), ``places`` (part, place, number, every), ``blocks`` (cell,
    part, n, keys, every, target: a part's pairs) and ``sums`` (cell, part, n, every, target: over all parts, in the order of the block), all distributed; and totals."""

    words: DataFrame
    places: DataFrame
    blocks: DataFrame
    sums: DataFrame
    cells: int
    size: int
    unknown: np.ndarray
    totals: np.ndarray
    starts: np.ndarray
    taken: np.ndarray


def scales(totals) -> np.ndarray:
    """The background is brought to the size of the target."""
    return np.array([totals[1] / max(totals[0], 1) if totals[1] else 1.0, 1.0])


def word_counts(rows: Rows) -> DataFrame:
    """part, place, word (hash), every, target: the words of each part."""

    def count(texts, hits):
        part, texts = texts.column("part")[0].as_py(), Part(texts)
        n = len(texts.words)
        every, target = (np.bincount(x, minlength=n + 1)[1:] for x in (texts.after, texts.after[texts.hit(hits)]))
        columns = [np.full(n, part), np.arange(1, n + 1, dtype=np.int32), texts.words, every.astype(np.int64), target.astype(np.int64)]
        return pa.Table.from_arrays([pa.array(x) for x in columns], names=["part", "place", "word", "every", "target"])

    return rows.sequences.groupBy("part").cogroup(rows.hits.groupBy("part")).applyInArrow(count, "part bigint, place int, word bigint, every bigint, target bigint")


def pair_blocks(rows: Rows, places: DataFrame, cells: int, starts: int) -> DataFrame:
    """A part's distinct pairs, one block per cell."""
    asked = rows.hits.select("part", "row").unionByName(places, allowMissingColumns=True)

    def blocks(texts, asked):
        import pyarrow.compute as pc

        part, texts = texts.column("part")[0].as_py(), Part(texts)
        is_hit = pc.is_valid(asked.column("row"))
        cell, key, _, every, target = texts.pairs(*texts.numbers(asked.filter(pc.invert(is_hit)), starts), cells, texts.hit(asked.filter(is_hit)))
        first = runs(cell)
        last = np.append(first[1:], len(cell))
        blobs = [[packed(x[i:j]) for i, j in zip(first, last)] for x in (every, target)]
        keys = [packed(np.diff(key[i:j], prepend=np.int64(0))) for i, j in zip(first, last)]
        columns = [pa.array(cell[first]), pa.array(np.full(len(first), part)), pa.array(last - first), *(pa.array(x, pa.binary()) for x in (keys, *blobs))]
        return pa.Table.from_arrays(columns, names=["cell", "part", "n", "keys", "every", "target"])

    schema = "cell bigint, part bigint, n bigint, keys binary, every binary, target binary"
    return rows.sequences.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(blocks, schema)


def block_sums(blocks: DataFrame, totals: np.ndarray, least_pair: float) -> DataFrame:
    """cell, part, n, every, target: sums over all parts for each block; number, every_taken, target_taken: what a cell's pairs take from a word."""
    scale, names = scales(totals), ["cell", "part", "n", "every", "target", "number", "every_taken", "target_taken"]

    def add(found):
        sizes = found.column("n").to_numpy()
        read = lambda c: [unpacked(x.as_py(), n, np.int64) for x, n in zip(found.column(c), sizes.tolist())]
        key = np.concatenate([np.cumsum(x) for x in read("keys")])
        order = np.argsort(key)
        key = key[order]
        first = runs(key)
        where = np.empty(len(key), np.int64)
        where[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
        key = key[first]
        sums = np.stack([np.add.reduceat(np.concatenate(read(c))[order], first) for c in ("every", "target")])
        del order
        if totals[0] and least_pair:
            sums[:, share(*totals.tolist())(*sums) < least_pair] = 0
        first = runs(key >> 32)
        taken = np.add.reduceat(np.maximum(sums * scale[:, None] - DISCOUNT, 0.0), first, axis=1)
        ends = np.cumsum(sizes)
        answers = [pa.array([packed(x[where[i:j]]) for i, j in zip(ends - sizes, ends)], pa.binary()) for x in sums]
        n = len(first)
        words = [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.binary())] * 2 + [pa.array(key[first] >> 32), *map(pa.array, taken)]
        n = len(sizes)
        blocks = [*(found.column(c).combine_chunks() for c in names[:3]), *answers, pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
        return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in (blocks, words)])

    return blocks.groupBy("cell").applyInArrow(add, "cell bigint, part bigint, n bigint, every binary, target binary, number bigint, every_taken double, target_taken double")


def counts_of(rows: Rows, least_word: float, least_pair: float) -> Counts:
    texts = rows.sequences.filter(F.col("row") > _VOCABULARY)
    sizes = [x.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first() for x in (texts, rows.hits)]
    totals, starts = (np.array([x[i] for x in sizes]) for i in (0, 1))
    vocabulary = saved(word_counts(rows), "vocabulary")
    words = vocabulary.groupBy("word").agg(F.sum("every").alias("every"), F.sum("target").alias("target"))
    if totals[0] and least_word:
        words = words.filter(share(*totals.tolist())(F.col("every"), F.col("target")) >= least_word)
    group = F.pmod("word", F.lit(NUMBER_GROUPS))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("every"), "word"))
    words = saved(words.withColumn("number", rank * F.lit(NUMBER_GROUPS).cast("bigint") + group), "words")
    places = saved(vocabulary.select("part", "place", "word").join(words.select("word", "number", "every").hint("merge"), "word").drop("word"), "places")
    size, *known = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("every"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    cells = int(totals[0]) // CELL_TOKENS + 1
    blocks = pair_blocks(rows, places, cells, int(starts[0]))
    sums = saved(block_sums(blocks, totals, least_pair), "sums")
    taken = sums.filter("number IS NOT NULL").groupBy("number").agg(F.sum("every_taken").alias("every_taken"), F.sum("target_taken").alias("target_taken"))
    start = taken.filter(F.col("number") == _START).first()
    words = words.join(taken.hint("merge"), "number", "left").na.fill(0.0, ["every_taken", "target_taken"])
    return Counts(
        words.select("number", "every", "target", "every_taken", "target_taken"), places, blocks, sums.filter("part IS NOT NULL").select("cell", "part", "n", "every", "target"),
        cells, size, totals - np.array(known), totals, starts, np.array([start.every_taken, start.target_taken] if start else [0.0, 0.0]),
    )


class Models:
    """Word and pair probabilities of both models as arrays, over some of the words and their pairs."""

    def __init__(self, words: np.ndarray, taken: np.ndarray, pairs: np.ndarray, counts: np.ndarray, size: int, unknown: np.ndarray, totals: np.ndarray, starts: np.ndarray, start_taken: np.ndarray):
        """words: counts [model, word from number 2 on]; taken: from their pairs; pairs: sorted; counts: [model, pair]; then those of ``Counts``."""
        scale = scales(totals)
        self.word = np.concatenate([(unknown * scale)[:, None], np.zeros((2, 1)), words * scale[:, None]], axis=1) + 1.0
        self.word[:, _START] = 0
        self.word /= (totals * scale + size + 1)[:, None]
        context = np.maximum(np.concatenate([np.ones((2, 1)), (starts * scale)[:, None], words * scale[:, None]], axis=1), 1e-9)
        self.pairs, self.pair = pairs, counts * scale[:, None]
        self.pair -= DISCOUNT
        np.maximum(self.pair, 0, out=self.pair)
        for m in (0, 1):
            self.pair[m] /= context[m][pairs >> 32]
        self.rest = 1 - np.concatenate([np.zeros((2, 1)), start_taken[:, None], taken], axis=1) / context

    def losses(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each word, of which the one before is known, under the background and the target."""
        key = before << 32 | after
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        found = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        out = []
        for m in (0, 1):
            p = self.rest[m][before] * self.word[m][after]
            p[found] += self.pair[m][at[found]]
            out.append(-np.log(np.maximum(p, 1e-12)))
        return out[0], out[1]


def fitted(rows: Rows, least_word: float = 0.0, least_pair: float = 0.0):
    """The models of a small corpus in memory, as broadcasts of the vocabulary (numbers) and of what ``Models`` is made of."""
    c = counts_of(rows, least_word, least_pair)
    words = c.words.toArrow().sort_by("number")
    vocabulary = words.column("number").to_numpy()
    of = lambda *names: np.stack([words.column(n).to_numpy() for n in names])
    blocks = c.blocks.select("cell", "part", "keys").join(c.sums, ["cell", "part"]).toArrow().to_pylist()
    read = lambda name: np.concatenate([np.zeros(0, np.int64), *(unpacked(x[name], x["n"], np.int64) for x in blocks)])
    keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(x["keys"], x["n"], np.int64)) for x in blocks)])
    key, first = np.unique(keys, return_index=True)
    local = lambda number: np.where(number == _START, _START, np.searchsorted(vocabulary, number) + 2)
    pairs = local(key >> 32) << 32 | local(key & 0xFFFFFFFF)
    counts = np.stack([read("every"), read("target")])[:, first]
    context = rows.sequences.sparkSession.sparkContext
    return context.broadcast(vocabulary), context.broadcast((of("every", "target"), of("every_taken", "target_taken"), pairs, counts, c.size, c.unknown, c.totals, c.starts, c.taken))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", least_word: float = 0.0, least_pair: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: key, n_words, target_loss, background_loss (nats per word), score (their difference).

    ``target`` lists, in a column named like the key, rows of ``docs`` that are the target.
    """
    rows = marked(docs, target, key, text)
    c = counts_of(rows, least_word, least_pair)
    of_words = c.places.drop("every").join(c.words.withColumnsRenamed({"every": "all_rows", "target": "target_rows"}).hint("merge"), "number")
    asked = of_words.unionByName(c.sums, allowMissingColumns=True)
    cells, totals = c.cells, (c.size, c.unknown, c.totals, c.starts, c.taken)
    schema = schema_with_key(rows.sequences, key, "n_words bigint, target_loss double, background_loss double, score double")
    names = schema.names

    def score(texts, found):
        import pyarrow.compute as pc

        texts = Part(texts)
        is_word = pc.is_valid(found.column("place"))
        words, sums = found.filter(is_word), found.filter(pc.invert(is_word)).sort_by("cell")
        at = words.column("place").to_numpy() - 1
        columns = np.zeros((4, len(texts.words)))
        for i, c in enumerate(("all_rows", "target_rows", "every_taken", "target_taken")):
            columns[i, at] = words.column(c).to_numpy()
        number, tokens = texts.numbers(words.rename_columns({"all_rows": "every", "every": "unused"}), int(totals[3][0]))
        place = texts.pairs(number, tokens, cells)[2]
        order = np.argsort(place)
        place = place[order]
        counts = np.empty((2, len(place)), np.int64)
        for i, c in enumerate(("every", "target")):
            counts[i] = np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py(), n, np.int64) for x, n in zip(sums.column(c), sums.column("n").to_pylist()))])[order]
        # a place is its number in the part's models less one
        place += 1 << 32 | 1
        models = Models(columns[:2], columns[2:], place, counts, *totals)
        del counts, order, columns
        model_number = np.where(number == _UNKNOWN, _UNKNOWN, np.arange(len(number)) + 1)
        ends, out = np.cumsum(texts.sizes), []
        for a, b in slices(texts.sizes.tolist(), SCORED_TOKENS):
            i, j, sizes = ends[a] - texts.sizes[a], ends[b - 1], texts.sizes[a:b]
            row = np.repeat(np.arange(b - a), sizes)
            losses = models.losses(model_number[texts.before[i:j]], model_number[texts.after[i:j]])
            means = [np.bincount(row, loss, b - a) / np.maximum(sizes, 1) for loss in losses]
            none = sizes == 0
            values = [texts.rows.column("key").slice(a, b - a).combine_chunks(), pa.array(sizes), *(pa.array(x, pa.float64(), mask=none) for x in (means[1], means[0], means[1] - means[0]))]
            out.append(pa.Table.from_arrays(values, names=names))
        return pa.concat_tables(out)

    return rows.sequences.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(score, schema)
