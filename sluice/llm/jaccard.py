"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows with equal n-gram sets form one class, and classes are joined:

1. N-grams are ordered with the infrequent ones first, then by hash.  The
   n-grams of all rows are counted to tell which are frequent; they are marked
   in a bitmap of fixed size, whose errors only change the order, and any order
   gives the same result.  A set's *prefix* is its first n - ceil(0.85 n) + 1
   n-grams: sets that link share one there.
2. Near copies are contracted: classes that have two of three hashed minima in
   common with the class of their group that has the fewest infrequent n-grams
   are compared with it.  This is linear in the size of a group.
3. The product: the columns are the prefixes' n-grams, dealt out in blocks by
   the shuffle.  A column holds where in its order each set has the n-gram, so
   an entry bounds the overlap that a partner of some size can reach, and
   entries that no size in the column allows are dropped.  Columns inside one
   component are dropped, too; components that meet in a column are paired by
   the best bounds of their members, and then members whose own bounds allow a
   link: each must reach ceil(17 (m + n) / 37) with what lies behind the
   n-gram, and with all n-grams of its prefix that any other set shares.
4. The remaining pairs are compared as whole sets, and components are made of
   all links.

Whole sets never lie on disk: they are hashed again for the classes that a
bounded Bloom filter of the classes asked for lets through, and what it lets
through in error does not survive the join.

N-grams are sets of 64-bit hashes.  ASCII letters are lower-cased, words are
maximal runs without ASCII white space, and a text with fewer than ``size``
words, but not none, is one n-gram.  Texts without words (null, empty) have no
n-gram and no link.  Equal texts are linked.  Component ids are the smallest
key of the component (null keys do not count, and a component of only those
has a null id); every row is returned, repeated rows repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm.bloom import bloom_filter, bloom_flags, let_through
from sluice.llm.common import body_sizes, keyed_text, mixed, saved, schema_with_key, slices
from sluice.llm.links import components
from sluice.llm.lm_scores import packed, unpacked

SIZE = 4
PERCENT = 85
#: Rows that make an n-gram frequent: SAMPLE_COUNT for each SAMPLE_ROWS of the table, but for SAMPLE_EVERY times as many at most.  All rows are counted.
SAMPLE_EVERY, SAMPLE_ROWS, SAMPLE_COUNT, MAP_BITS = 10, 8000, 3, 27
#: N-grams that a task sorts at once, bytes of text whose n-grams meet in a cell of their count, and bytes that are read and sent at once for it.
RUN_GRAMS, CELL_BYTES, SENT_BYTES = 1 << 20, 4 << 20, 1 << 20
_MEMBERS = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MINIMA = (np.uint64(0), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))


class WordHashes(dict):
    """Word to a 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_sets(bodies: list[bytes | None], hashes: WordHashes, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    found = [b.lower().split() if b else [] for b in bodies]
    per_row = [len(x) for x in found]
    flat = np.fromiter((h for x in found for h in map(hashes.__getitem__, x)), np.uint64, sum(per_row))
    del found
    run = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        run *= _STEP
        run += flat[k : k + len(run)]
    run = mixed(run)
    at = 0
    for n in per_row:
        if n >= size:
            yield np.unique(run[at : at + n - size + 1])
        elif n:
            h = n
            for x in flat[at : at + n].tolist():
                h = (h * int(_STEP) + x) & (2**64 - 1)
            yield mixed(np.array([h], np.uint64))
        else:
            yield run[:0]
        at += n


def set_key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def at_most(times: int, x: np.ndarray) -> np.ndarray:
    """Of sorted values, ``times`` of each that stands there more often."""
    return x[np.concatenate([np.ones(min(times, len(x)), bool), x[times:] != x[:-times]])]


def frequent_ngrams(rows: DataFrame, size: int, every: int) -> bytes:
    """A bitmap of the n-grams that enough of all rows have: 2**MAP_BITS bits, by their highest bits.

    Tasks sort their n-grams in runs and send a run's n-grams of one cell, a
    range of hashes, as a block of compressed differences.  An n-gram that a run
    has often enough to settle the matter is not repeated further.
    """
    total, text = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    enough = SAMPLE_COUNT * max(1, min(every, total // SAMPLE_ROWS))
    # a cell has one word of the bitmap at least
    cell_bits = max(1, min(MAP_BITS - 6, (text // CELL_BYTES).bit_length()))
    run_grams, place = RUN_GRAMS, np.uint64(64 - MAP_BITS)

    def blocks(run):
        run.sort()
        run = at_most(enough, run)
        starts = np.searchsorted(run, np.arange(2**cell_bits, dtype=np.uint64) << np.uint64(64 - cell_bits))
        sizes = np.diff(starts, append=len(run))
        cells = np.flatnonzero(sizes)
        for a, b in slices((8 * sizes[cells]).tolist(), SENT_BYTES):
            some = cells[a:b]
            grams = [packed(np.diff(run[starts[c] : starts[c] + sizes[c]], prepend=np.uint64(0))) for c in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sizes[some], pa.int32()), pa.array(grams, pa.binary())], names=["cell", "n", "grams"])

    def listed(batches):
        hashes, run, held = WordHashes(), np.empty(run_grams, np.uint64), 0
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(0)), SENT_BYTES):
                for s in ngram_sets(batch.column(0).slice(a, b - a).to_pylist(), hashes, size):
                    while len(s):
                        more = s[: run_grams - held]
                        run[held : held + len(more)] = more
                        s, held = s[len(more) :], held + len(more)
                        if held == run_grams:
                            yield from blocks(run)
                            held = 0
            pa.default_memory_pool().release_unused()
        yield from blocks(run[:held])

    def often(runs):
        x = np.concatenate(runs)
        x.sort()
        first = x[: max(0, len(x) - enough + 1)]
        bits = np.unique(first[first == x[enough - 1 :]] >> place)
        return pa.RecordBatch.from_arrays([pa.array(signed(bits))], names=["bit"])

    def counted(batches):
        cell, runs = None, []
        for batch in batches:
            for c, n, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c != cell and runs:
                    yield often(runs)
                    runs = []
                cell = c
                runs.append(np.cumsum(unpacked(grams.as_py(), n, np.uint64), dtype=np.uint64))
            pa.default_memory_pool().release_unused()
        if runs:
            yield often(runs)

    cells = rows.select("body").mapInArrow(listed, "cell int, n int, grams binary").repartition("cell").sortWithinPartitions("cell")
    bit = cells.mapInArrow(counted, "bit bigint")
    mask = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    words = bit.select(F.shiftright("bit", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    flags = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    flags[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return flags.tobytes()


def digest(text: str):
    """What tells the texts of one key apart."""
    return F.xxhash64(F.col(text).cast("binary"))


def least_overlap(n: int) -> int:
    return (PERCENT * n + 99) // 100


def signatures(rows: DataFrame, frequent: bytes, size: int) -> DataFrame:
    """key, digest, n, set_key; and of sets not met in the task before: rare (infrequent n-grams), minima, prefix (in the common order)."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches):
        hashes, bits, met = WordHashes(), np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for a, b in slices(body_sizes(batch.column(1))):
                n, keys, rare, minima, prefixes = [], [], [], [], []
                for s in ngram_sets(batch.column(1).slice(a, b - a).to_pylist(), hashes, size):
                    n.append(len(s))
                    keys.append(set_key(s))
                    if not len(s) or keys[-1] in met:
                        rare.append(None), minima.append(None), prefixes.append(None)
                        continue
                    if len(met) > 500_000:
                        met.clear()
                    met.add(keys[-1])
                    place = s >> np.uint64(64 - MAP_BITS)
                    known = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    rare.append(int(len(s) - known.sum()))
                    minima.append([int(signed(mixed(s ^ m)).min()) for m in _MINIMA])
                    prefixes.append(np.concatenate([s[~known], s[known]])[: len(s) - least_overlap(len(s)) + 1])
                offsets = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in prefixes])]).astype(np.int32)
                flat = signed(np.concatenate([np.zeros(0, np.uint64), *[p for p in prefixes if p is not None]]))
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([p is None for p in prefixes], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(rare, pa.int32()), pa.array(minima, pa.list_(pa.int64())), prefix],
                    names=["key", "digest", "n", "set_key", "rare", "minima", "prefix"],
                )

    return rows.withColumn("digest", digest("body")).mapInArrow(sign, schema_with_key(rows, "key", "digest bigint, n int, set_key binary, rare int, minima array<bigint>, prefix array<bigint>"))


def needed_overlap(m, n):
    """The smallest overlap with 100 * overlap >= 85 * (m + n - overlap)."""
    return F.ceil(F.lit(PERCENT) * (m + n) / F.lit(100 + PERCENT) - F.lit(1e-9))


def behind_prefix(n):
    """N-grams of a set that are not in its prefix."""
    return F.floor((F.lit(PERCENT) * n + 99) / 100) - 1


def whole_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_key and the whole n-gram set (bytes of sorted hashes) of the wanted classes (key of one row, set_key), and of few others."""
    shared = bloom_filter(wanted.select("key"))

    def found(batches):
        hashes = WordHashes()
        flags = bloom_flags(shared.value)
        for batch in batches:
            asked = let_through(flags, batch.column(1).to_numpy())
            bodies = batch.column(0).filter(pa.array(asked))
            for a, b in slices(body_sizes(bodies)):
                sets = [s for s in ngram_sets(bodies.slice(a, b - a).to_pylist(), hashes, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "grams"])

    return rows.select("body", F.xxhash64("key").alias("h")).mapInArrow(found, "set_key binary, grams binary")


def linked(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity.

    Pairs are grouped by b; a b with many partners is copied to one group for
    each ``_MEMBERS`` of them, and a group is read as a stream behind its b.
    Where a set goes is settled before sets are moved.
    """
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("parts"))
    members = pairs.join(groups, "b").select(F.col("a").alias("class"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = groups.select(F.col("b").alias("class"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    routes = saved(members.union(heads).join(classes.select("class", F.col("least").alias("key"), "set_key"), "class"), "routes")
    sets = whole_sets(rows, routes.select("key", "set_key").distinct(), size)
    sent = sets.join(routes.select("set_key", "b", "part", "role", F.col("class").alias("a")), "set_key").select("b", "part", "role", "a", "grams")
    streams = sent.repartition("b", "part").sortWithinPartitions("b", "part", "role")

    def compare(batches):
        head, owner = None, None
        for batch in batches:
            out_a, out_b = [], []
            for b, role, a, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                s = np.frombuffer(grams, np.uint64)
                if role == 0:
                    head, owner = s, b
                elif owner == b:
                    small, large = (s, head) if len(s) < len(head) else (head, s)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= PERCENT * (len(s) + len(head) - both):
                        out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return saved(streams.mapInArrow(compare, "a bigint, b bigint").distinct(), "links")


@dataclass
class Joined:
    """``rows``: key, digest, n, set_key per row; ``classes``: set_key, class, least (smallest key), first (smallest key and digest); ``labels``: class (as node) to component."""

    rows: DataFrame
    classes: DataFrame
    labels: DataFrame


def contracted_stars(rows: DataFrame, nodes: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Links of classes to the plainest class of their groups by minima."""
    minima = nodes.select("set_key", "rare", F.posexplode("minima").alias("slot", "low")).join(classes.select("set_key", "class"), "set_key")
    pivots = minima.groupBy("slot", "low").agg(F.min(F.struct("rare", "class"))["class"].alias("b"), F.max("class").alias("most"), F.min("class").alias("fewest"))
    near = minima.join(pivots.filter("most <> fewest").select("slot", "low", "b"), ["slot", "low"]).filter("class <> b")
    twice = near.groupBy(F.col("class").alias("a"), "b").agg(F.count_distinct("slot").alias("slots")).filter("slots > 1")
    return linked(rows, classes, twice, size)


def live_cells(nodes: DataFrame, classes: DataFrame, contracted: DataFrame) -> DataFrame:
    """gram, class, component, n, place (in the set's order) and shared (n-grams of the prefix that other sets have) of cells that may count."""
    cells = nodes.select("rid", "n", F.posexplode("prefix").alias("place", "gram"))
    column = Window.partitionBy("gram")
    # a partner's size n must let the overlap reach 17 (m + n) / 37 with the m - place n-grams that are left
    largest = F.floor(F.lit(100 + PERCENT) * (F.col("n") - F.col("place")) / F.lit(PERCENT)) - F.col("n")
    met = cells.withColumn("low", F.min("rid").over(column)).withColumn("high", F.max("rid").over(column)).withColumn("least_n", F.min("n").over(column))
    met = met.filter("low <> high").select("gram", "rid", "n", "place", (largest >= F.col("least_n")).alias("hopeful"))
    labels = nodes.select("rid", "set_key").join(classes.select("set_key", "class"), "set_key").join(contracted, F.col("class") == F.col("node"), "left")
    labels = labels.select("rid", "class", F.coalesce("component", "class").alias("component"))
    counted = met.join(labels, "rid").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("rid")))
    return saved(counted.filter("hopeful").drop("rid", "hopeful"), "cells")


def candidates(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes from different components that meet in a column where their bounds allow a link."""
    spots = live.groupBy("gram", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("left"), F.max("shared").alias("shared")
    )
    spots = saved(spots.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("met > 1").drop("met"), "spots")
    x = spots.select("gram", F.col("component").alias("ca"), *[F.col(c).alias(f"x_{c}") for c in _BOUNDS])
    y = spots.select(F.col("gram").alias("gram_y"), F.col("component").alias("cb"), *[F.col(c).alias(f"y_{c}") for c in _BOUNDS])
    meetings = x.join(y, (F.col("gram") == F.col("gram_y")) & (F.col("ca") < F.col("cb")) & _possible("x", "y")).select("gram", "ca", "cb", *[f"y_{c}" for c in _BOUNDS])
    one = _members(live, "a").withColumnsRenamed({"gram": "gram_a", "component": "own"})
    met = meetings.join(one, (F.col("gram") == F.col("gram_a")) & (F.col("ca") == F.col("own")) & _possible("a", "y")).select("gram", "cb", "a", *[f"a_{c}" for c in _BOUNDS])
    two = _members(live, "b").withColumnsRenamed({"gram": "gram_b", "component": "own"})
    return met.join(two, (F.col("gram") == F.col("gram_b")) & (F.col("cb") == F.col("own")) & _possible("a", "b")).select("a", "b")


#: Smallest and largest size, most n-grams from the place on, most shared n-grams: of a component in a column, or of one member.
_BOUNDS = ("low", "high", "left", "shared")


def _members(live: DataFrame, name: str) -> DataFrame:
    bounds = [F.col("n"), F.col("n"), F.col("n") - F.col("place"), F.col("shared")]
    return live.select("gram", "component", F.col("class").alias(name), *[b.alias(f"{name}_{c}") for b, c in zip(bounds, _BOUNDS)])


def _possible(x: str, y: str):
    """Whether sets within two rows of bounds can link (for single members: whether theirs allow it)."""
    (low, high, left, shared), (low_y, high_y, left_y, shared_y) = ([F.col(f"{side}_{c}") for c in _BOUNDS] for side in (x, y))
    need = needed_overlap(low, low_y)
    sizes = 100 * F.least(high, high_y) >= PERCENT * F.greatest(low, low_y)
    return sizes & (F.least(left, left_y) >= need) & (F.least(shared, shared_y) + F.greatest(behind_prefix(high), behind_prefix(high_y)) >= need)


def _named():
    """Key and digest of a row that has a key."""
    return F.when(F.col("key").isNotNull(), F.struct("key", "digest"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, every: int = SAMPLE_EVERY) -> Joined:
    rows = keyed_text(docs, key, text)
    signed_rows = saved(signatures(rows, frequent_ngrams(rows, size, every), size).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = saved(signed_rows.filter("n > 0").groupBy("set_key").agg(F.min("rid").alias("class"), F.min("key").alias("least"), F.min(_named()).alias("first")), "classes")
    # of sets below 6 n-grams only equal ones link; equal sets that several tasks met are one class
    nodes = signed_rows.filter("n >= 6 AND prefix IS NOT NULL")
    stars = contracted_stars(rows, nodes, classes, size)
    live = live_cells(nodes, classes, components(stars))
    links = stars.union(linked(rows, classes, candidates(live), size))
    return Joined(signed_rows.select("key", "digest", "n", "set_key"), classes, components(links))


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, every: int = SAMPLE_EVERY) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id."""
    joined = jaccard_join(docs, key, text, size, every)
    labelled = joined.classes.join(joined.labels, F.col("class") == F.col("node"), "left").select(
        "set_key", "least", F.coalesce("component", "class").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("set_key", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    return joined.rows.join(named, "set_key", "left").select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), own)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, every: int = SAMPLE_EVERY) -> DataFrame:
    """copy_key and copy_digest, once each, of the rows that are not their component's row with the smallest key and digest.

    Rows of one key are judged by their own texts.  Rows without a key are no copies, and none is a copy of them.
    """
    joined = jaccard_join(docs, key, text, size, every)
    labelled = joined.classes.join(joined.labels, F.col("class") == F.col("node"), "left").select("set_key", "first", F.coalesce("component", "class").alias("component"))
    chosen = labelled.groupBy("component").agg(F.min("first").alias("chosen"))
    named = labelled.join(chosen, "component").select("set_key", "chosen")
    found = joined.rows.filter("n > 0").withColumn("own", _named()).join(named, "set_key").filter("own <> chosen")
    return found.select(F.col("key").alias("copy_key"), F.col("digest").alias("copy_digest")).distinct()
