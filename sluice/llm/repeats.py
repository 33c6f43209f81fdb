"""Removal of repeated byte strings by column-wise construction over many texts.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else, in the same text or another.

1. Every string of ``length`` bytes holds an *anchor*: of each run of its
   GRAM-byte substrings the one with the smallest hash is chosen (all of them
   on ties), so equal strings hold equal anchors at equal offsets.  Substrings
   with a period of PERIOD bytes or less (rows of dashes, one word over and
   over) would tie at every step and are passed over; a string that holds
   nothing else is its own anchor, of which a stretch has as many as the period,
   and a stretch longer than the string and its period repeats itself.
2. Anchors whose hash stands at two places or more keep their *context*, all
   bytes that a string of ``length`` around the anchor can reach.  Equal
   contexts are counted and kept once.
3. The different contexts of an anchor are sorted column-wise: each round puts
   one more symbol before every context, from the last column to the first;
   the symbols in the present order are the column's part of the collection's
   Burrows-Wheeler transform, a stable sort by symbol gives the next order, and
   common prefixes follow from those of the round before.  The string that
   starts at a column is repeated if it shares ``length`` symbols with a
   neighbour in the order.
4. All repeated strings around an anchor hold the anchor, so their union is one
   interval.  Intervals are merged per text.

Columns stand in memory one behind the other, and each is read once, from last
to first; a task sorts a bounded number of contexts at a time.  Anchors with
more different contexts than that are settled by counting the hashes of their
strings instead, which spreads over tasks.

Passages of words go the same way, over texts made of the 64-bit hashes of the
words: a passage of n words is a string of 8 * n bytes there, whatever white
space divides the words.

Equal texts are counted first: each is repeated as a whole if it has
``length`` bytes.  Texts are known by a 128-bit digest, so rows without key and
repeated rows are rows like others.  Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm.bloom import bloom_filter, bloom_flags, let_through
from sluice.llm.common import body_sizes, key_type, mixed, saved, slices

LENGTH, GRAM, PERIOD = 400, 100, 12
#: Bytes that stand for a word.
WORD = 8
#: Contexts that a task sorts at a time.
CONTEXTS = 16_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class GramHashes:
    """Hashes of all substrings of ``gram`` bytes, from one running sum."""

    def __init__(self, gram: int):
        self.gram, self.up, self.down = gram, powers(_BASE, 1), powers(_INVERSE, 1)

    def running(self, body: bytes) -> np.ndarray:
        n = len(body)
        if n > len(self.up):
            self.up, self.down = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_HASH[np.frombuffer(body, np.uint8)] * self.down[:n], out=run[1:])
        return run

    def __call__(self, body: bytes) -> np.ndarray:
        run = self.running(body)
        return mixed((run[self.gram :] - run[: -self.gram]) * self.up[: len(body) - self.gram + 1])


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of bytes other than white space) start and end."""
    edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(body, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class WordHashes(GramHashes):
    """Hashes of the words of a text, one behind the other."""

    def __call__(self, body: bytes) -> np.ndarray:
        start, end = words_of(body)
        run = self.running(body)
        return mixed((run[end] - run[start]) * self.up[start])


def sliding(x: np.ndarray, width: int, pick: np.ufunc, pad: int) -> np.ndarray:
    """``pick`` over every run of ``width`` values, from running values in blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, pad, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


_NONE = np.uint64(2**64 - 1)


def short_periods(b: np.ndarray, gram: int) -> np.ndarray | None:
    """The smallest period up to PERIOD of the substring of ``gram`` bytes at each place (0: none); None if there is none at all."""
    n, step = len(b), max(1, gram // 12)
    sparse = [q for q in range(1, min(PERIOD, gram // 2) + 1) if _has_run(b[:-q:step] == b[q::step], (gram - q) // step - 1)]
    found = None
    for q in reversed(sparse):
        run = np.concatenate([[0], np.cumsum(b[:-q] == b[q:])])
        same = run[gram - q :] - run[: -(gram - q)] == gram - q
        places = np.flatnonzero(same[: n - gram + 1])
        if len(places):
            found = np.zeros(n - gram + 1, np.int64) if found is None else found
            found[places] = q
    return found


def _has_run(flags: np.ndarray, size: int) -> bool:
    """Whether ``size`` flags in a row are set."""
    gaps = np.flatnonzero(np.concatenate([[True], ~flags, [True]]))
    return bool((np.diff(gaps) > size).any())


def anchors_of(x: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the smallest of some run of ``width`` values."""
    low = sliding(x, width, np.minimum, 2**64 - 1)
    around = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(low)] = low
    around[around == _NONE] = 0
    return np.flatnonzero(sliding(around, width, np.maximum, 0) == x)


def periodic_strings(x: np.ndarray, period: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(first string, number of strings, period) of stretches of strings that hold periodic substrings alone."""
    alone = sliding(x, length - gram + 1, np.minimum, 2**64 - 1) == _NONE
    edge = np.diff(np.concatenate([[0], alone.astype(np.int8), [0]]))
    return [(a, b - a, int(period[a])) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def all_anchors(body: bytes, grams: GramHashes, strings: GramHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, and reach: 0, or for a string that is its own anchor its length (or that of the stretch that repeats itself)."""
    gram, length = grams.gram, strings.gram
    x = grams(body)
    period = short_periods(np.frombuffer(body, np.uint8), gram)
    if period is None:
        at = anchors_of(x, length - gram + 1)
        return at, x[at], np.zeros(len(at), np.int64)
    x = np.where(period > 0, _NONE, x)
    at = anchors_of(x, length - gram + 1)
    places, reach = [at], [np.zeros(len(at), np.int64)]
    for first, count, q in periodic_strings(x, period, length, gram):
        own = np.arange(first, first + min(count, q))
        places.append(own)
        reach.append(np.full(len(own), length))
        if count > q:
            reach[-1][0] = length + count - 1
    where, far = np.concatenate(places), np.concatenate(reach)
    whole = far > 0
    hashes = np.empty(len(where), np.uint64)
    hashes[~whole] = x[where[~whole]]
    if whole.any():
        hashes[whole] = strings(body)[where[whole]]
    return where, hashes, far


def sorted_columns(columns: np.ndarray, group: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """For each column from the last that starts a string of ``length`` to the first: which contexts have a repeated string there.

    ``columns[k]`` holds symbol k of every context (256 and above: none, equal
    to nothing); ``group`` is ascending, and contexts meet only in their group.
    """
    width, n = columns.shape
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # symbols shared with the context before in the order
    first = np.concatenate([[True], group[1:] != group[:-1]])
    sorted_group = group.astype(np.int64) << 10
    for k in range(width - 1, -1, -1):
        transform = columns[k][order]
        step = np.argsort(sorted_group | transform, kind="stable")  # groups keep their places
        symbol = transform[step]
        order = order[step]
        same = np.concatenate([[False], (symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)]) & ~first
        at = np.flatnonzero(same)
        shared = np.zeros(n + 1, np.int32)
        if len(at):
            bounds = np.stack([step[at - 1] + 1, step[at] + 1], axis=1).ravel()
            shared[at] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = shared
        if k <= width - length:
            long = common >= length
            repeated = np.zeros(n, bool)
            repeated[order] = long[:-1] | long[1:]
            yield repeated


def content(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, body (null: empty), and the digest that stands for the body."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    return rows.withColumn("digest", F.unhex(F.md5("body")))


def worded(rows: DataFrame, words: int) -> DataFrame:
    """The rows with ``words`` words or more; the body is the hashes of the words, key and digest stay."""
    key_sql = key_type(rows).simpleString()

    def hashed(batches):
        hashes = WordHashes(1)
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                bodies = [hashes(body).tobytes() if len(body) >= 2 * words - 1 else b"" for body in part.column(1).to_pylist()]
                made = pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary()), part.column(2)], names=["key", "body", "digest"])
                yield made.filter(pa.array([len(x) >= WORD * words for x in bodies], pa.bool_()))

    return rows.select("key", "body", "digest").mapInArrow(hashed, f"key {key_sql}, body binary, digest binary")


class Seen(set):
    """Digests met in a task, to skip copies; forgetting some only costs time."""

    def fresh(self, digest: bytes) -> bool:
        if digest in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(digest)
        return True


def repeated_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """digest, key (of one row with that text) and its anchors that stand at two places or more: places, hashes."""
    key_sql = key_type(rows).simpleString()

    def choose(batches):
        grams, strings, seen = GramHashes(gram), GramHashes(length), Seen()
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                found, taken = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], []
                for i, (body, digest) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if len(body) >= length and seen.fresh(digest):
                        found.append(all_anchors(body, grams, strings))
                        taken.append(i)
                rep = pa.array(np.repeat(np.array(taken, np.int64), np.array([len(f[0]) for f in found[1:]], np.int64)))
                places, hashes, reach = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rep), part.column(2).take(rep), pa.array(places, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(reach, pa.int32())],
                    names=["key", "digest", "place", "hash", "reach"],
                )

    anchors = rows.select("key", "body", "digest").mapInArrow(choose, f"key {key_sql}, digest binary, place int, hash bigint, reach int")
    again = anchors.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("hash"))).filter((F.col("met") > 1) | (F.col("reach") > length))
    return again.groupBy("digest").agg(F.min("key").alias("key"), F.collect_set(F.struct("place", "hash", "reach")).alias("anchors"))


def contexts(rows: DataFrame, anchors: DataFrame, length: int, gram: int) -> DataFrame:
    """hash, context (digest of the bytes and their place), digest, place and reach of each anchor; the bytes once per task."""
    shared = bloom_filter(anchors.select("digest"))

    def few(batches):
        flags = bloom_flags(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(let_through(flags, batch.column(3).to_numpy()))).select([0, 1, 2])

    key_sql = key_type(rows).simpleString()
    likely = rows.select("key", "body", "digest", F.xxhash64("digest").alias("h")).mapInArrow(few, f"key {key_sql}, body binary, digest binary")
    met = likely.alias("r").join(anchors.alias("a"), (F.col("r.digest") == F.col("a.digest")) & F.col("r.key").eqNullSafe(F.col("a.key")))
    left = length - gram

    def cut(batches):
        seen, known = Seen(), Seen()
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                out: list[list] = [[] for _ in range(7)]
                for digest, body, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if not seen.fresh(digest):
                        continue
                    for x in sorted(found, key=lambda x: x["place"]):
                        place = x["place"]
                        before = 0 if x["reach"] else min(left, place)
                        piece = body[place - before : place + length]
                        name = xxhash.xxh3_128_digest(before.to_bytes(4, "big") + piece)
                        fresh = known.fresh(name + x["hash"].to_bytes(8, "big", signed=True))
                        for column, value in zip(out, (x["hash"], name, digest, place, x["reach"], before, piece if fresh else None)):
                            column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["hash", "context", "digest", "place", "reach", "before", "piece"])

    cuts = met.select("r.digest", "r.body", "a.anchors").mapInArrow(cut, "hash bigint, context binary, digest binary, place int, reach int, before int, piece binary")
    return saved(cuts, "contexts")


def sorted_ranges(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """hash, context, low, high: a string of ``length`` from ``low`` to ``high`` bytes before the anchor is repeated in another context."""
    left = length - gram
    width = left + length

    def settle(names: list[tuple[int, bytes]], before: list[int], found: list[bytes]) -> pa.RecordBatch:
        n = len(names)
        flat = np.full((n, width), 256, np.uint16)
        for i, (b, piece) in enumerate(zip(before, found)):
            flat[i, left - b : left - b + len(piece)] = np.frombuffer(piece, np.uint8)
        hashes = np.array([h for h, _ in names])
        group = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
        low, high = np.full(n, width, np.int32), np.full(n, -1, np.int32)
        for distance, repeated in enumerate(sorted_columns(np.ascontiguousarray(flat.T), group, length)):
            np.minimum(low, np.where(repeated, distance, width), out=low)
            high[repeated] = distance
        some = np.flatnonzero(high >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes[some]), pa.array([names[i][1] for i in some], pa.binary()), pa.array(low[some]), pa.array(high[some])], names=["hash", "context", "low", "high"]
        )

    def sort(batches):
        names: list[tuple[int, bytes]] = []
        before, found = [], []
        for batch in batches:
            for h, name, b, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if names and (h, name) == names[-1]:
                    continue
                if len(names) >= CONTEXTS and h != names[-1][0]:
                    yield settle(names, before, found)
                    names, before, found = [], [], []
                names.append((h, name)), before.append(b), found.append(piece)
        if names:
            yield settle(names, before, found)

    ordered = pieces.select("hash", "context", "before", "piece").repartition("hash").sortWithinPartitions("hash", "context")
    return ordered.mapInArrow(sort, "hash bigint, context binary, low int, high int")


def counted_ranges(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with too many contexts for a task: the strings' hashes are counted."""
    left = length - gram

    def strings(batches):
        for batch in batches:
            for h, name, b, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = range(max(0, length - (len(piece) - b)), min(left, b) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(at), pa.int64()), pa.array([name] * len(at), pa.binary()), pa.array(at, pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(piece[b - d : b - d + length]) for d in at], pa.binary())],
                    names=["hash", "context", "distance", "string"],
                )

    rows = pieces.select("hash", "context", "before", "piece").dropDuplicates(["hash", "context"]).mapInArrow(strings, "hash bigint, context binary, distance int, string binary")
    rows = saved(rows, "strings")
    again = rows.groupBy("hash", "distance", "string").count().filter("count > 1")
    return rows.join(again, ["hash", "distance", "string"]).groupBy("hash", "context").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))


def removals(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CONTEXTS) -> DataFrame:
    """digest, copies, spans (start, end; not merged) of every text of which something is removed; copies go as a whole."""
    copies = rows.filter(F.octet_length("body") >= length).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    found = contexts(rows, saved(repeated_anchors(rows, length, gram), "anchors"), length, gram)
    pieces = found.filter("piece IS NOT NULL")
    crowded = pieces.select("hash", "context").distinct().groupBy("hash").count().filter(F.col("count") > crowd).select("hash")
    if crowded.isEmpty():
        ranges = sorted_ranges(pieces, length, gram)
    else:
        ranges = sorted_ranges(pieces.join(crowded, "hash", "left_anti"), length, gram).union(counted_ranges(pieces.join(crowded, "hash", "left_semi"), length, gram))
    reach = F.least(F.col("before"), F.lit(length - gram))
    twice = found.groupBy("hash", "context").agg(
        F.count(F.lit(1)).alias("places"), F.max("before").alias("before"), F.max(F.octet_length("piece")).alias("bytes")
    ).filter("places > 1").select("hash", "context", F.greatest(F.lit(0), F.lit(length) - (F.col("bytes") - F.col("before"))).alias("low"), reach.alias("high"))
    every = ranges.union(twice.filter("low <= high")).groupBy("hash", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = found.select("hash", "context", "digest", "place").join(every, ["hash", "context"]).select(
        "digest", F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end")).alias("span")
    )
    stretches = found.filter(F.col("reach") > length).select("digest", F.struct(F.col("place").alias("start"), (F.col("place") + F.col("reach")).alias("end")).alias("span"))
    listed = spans.union(stretches).groupBy("digest").agg(F.collect_set("span").alias("spans"))
    return copies.join(listed, "digest", "left").filter("copies > 1 OR spans IS NOT NULL")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def runs_of(size: int, copies: int | None, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """What is removed from a text of ``size`` bytes."""
    if copies is not None and copies > 1:
        return [(0, size)] if size >= length else []
    return merged((s["start"], s["end"]) for s in spans) if spans else []


def word_runs(body: bytes, copies: int | None, spans: list[dict] | None, words: int) -> list[tuple[int, int]]:
    """The same for passages of words, from spans over the hashes of the words: from the first to the last word of each."""
    if copies is None and spans is None:
        return []
    first, last = words_of(body)
    runs = [(-(-a // WORD), b // WORD) for a, b in runs_of(WORD * len(first), copies, spans, WORD * words)]
    return [(int(first[a]), int(last[b - 1])) for a, b in runs]


def without(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    behind, kept = 0, []
    for start, end in runs:
        kept.append(body[behind:start])
        behind = end
    return b"".join([*kept, body[behind:]])


def removal_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 (of the bytes that stay)."""
    rows = content(docs, key, text)
    removed = saved(removals(rows, length, gram), "removals")
    shared = bloom_filter(removed.select("digest"))
    key_sql = key_type(rows).simpleString()

    def settled(batches):
        """Texts that nothing is removed from are finished here; the others keep their bodies for the join."""
        flags = bloom_flags(shared.value)
        for batch in batches:
            asked = let_through(flags, batch.column(3).to_numpy()).tolist()
            bodies = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b if m else None for b, m in zip(bodies, asked)], pa.binary()), pa.array(map(len, bodies), pa.int64()),
                 pa.array([None if m else hashlib.sha256(b).hexdigest() for b, m in zip(bodies, asked)], pa.string())],
                names=["key", "digest", "body", "size", "sha"],
            )

    split = rows.select("key", "body", "digest", F.xxhash64("digest").alias("h")).mapInArrow(settled, f"key {key_sql}, digest binary, body binary, size bigint, sha string")

    def finished(batches):
        for batch in batches:
            gone, counts, shas = [], [], []
            for body, size, sha, copies, spans in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                runs = runs_of(size, copies, spans, length) if sha is None else []
                gone.append(sum(end - start for start, end in runs))
                counts.append(len(runs))
                shas.append(sha or hashlib.sha256(without(body, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = split.join(removed, "digest", "left").select("key", "body", "size", "sha", "copies", "spans")
    return joined.mapInArrow(finished, f"`{key}` {key_sql}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def whole_characters(body: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the bytes of characters that they cover in part."""
    out = []
    for start, end in runs:
        while start < end and body[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated strings cut out of the text; a character goes if all its bytes do.  Null texts stay null.

    With ``words``, passages of that many words that also start anywhere else are
    cut out, too, however short; both are judged on the texts as they come.
    """
    names = docs.columns
    n = len(names)
    bodies = content(docs, key, text)
    removed = removals(bodies, length, gram)
    if words is None:
        nothing = removed.schema
        removed = removed.select("*", *[F.lit(None).cast(nothing[c].dataType).alias(f"word_{c}") for c in ("copies", "spans")])
    else:
        passages = removals(worded(bodies, words), WORD * words, WORD * max(1, words // 4))
        removed = removed.join(passages.withColumnsRenamed({"copies": "word_copies", "spans": "word_spans"}), "digest", "full")
    removed = saved(removed, "removals")
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text].cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.coalesce("body", F.lit(b"")))))
    shared = bloom_filter(removed.select("digest"))

    def asked(wanted: bool):
        """Rows that may be in the table of removals, or those that are not."""

        def choose(batches):
            flags = bloom_flags(shared.value)
            for batch in batches:
                yield batch.filter(pa.array(let_through(flags, batch.column(n + 2).to_numpy()) == wanted)).select(list(range(n + 2)))

        return rows.withColumn("h", F.xxhash64("digest")).mapInArrow(choose, ", ".join([*kinds, "body binary, digest binary"]))

    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:n])]
    likely = asked(True)
    joined = likely.join(removed, "digest", "left").select(*likely.columns[: n + 1], "copies", "spans", "word_copies", "word_spans")

    def gone(body: bytes, copies, spans, word_copies, word_spans) -> list[tuple[int, int]]:
        runs = runs_of(len(body), copies, spans, length)
        return whole_characters(body, merged(runs + word_runs(body, word_copies, word_spans, words)) if words else runs)

    def cut(batches):
        for batch in batches:
            bodies = [
                None if body is None else without(body, gone(body, *found))
                for body, *found in zip(*(batch.column(i).to_pylist() for i in range(n, n + 5)))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(bodies, pa.binary())], names=[*[f"c{i}" for i in range(n)], "body"])

    # texts that nothing is removed from never move
    made = joined.mapInArrow(cut, ", ".join([*kinds, "body binary"])).unionByName(asked(False).drop("digest"))
    return made.select(*[(F.col("body").cast("string") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
