"""How five filters interact: what each removes, in every order of them.

Filters, on whole texts (null counts as empty; a word is a run of bytes that are
not white space): A under 50 words, B under 65 % distinct words, C over 5 %
capital letters, D any of ``#$%&*|``, E identical to the text of a smaller id
anywhere in the table.  The failures of a document are a mask of five bits.

Duplicates are found in radix tries of whole texts.  A bounded sample of texts
gives prefixes, only as long as they must be to tell neighbours apart, that cut
the table into ranges of equal size; where one prefix of PREFIX bytes fills
several ranges, its texts are dealt out over them by digest.  In a range texts
stand sorted and are inserted into a compressed trie whose terminals hold the
smallest id.  After TRIE_BYTES of text the trie is traversed, each terminal
giving the flags of its documents, and a new one begins with the last text, so
memory does not depend on the size of a range.

Copies are settled before the shuffle as far as possible: a task that has met
the same text (by 128-bit digest) under a smaller id knows that the row fails E
and sends its id and mask, not the text.  So of a text on a third of all rows
each task sends a few copies only.

Masks are counted per part, with labels joined by id, and the 600 lines of a part
are sums over at most 32 masks.

A row without id fails E never and makes no other row fail it.  Rows that share
id and text are neither's duplicate.  Labels of one id count together: it is good
if any of them says so.  A null part is the empty string; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text of a range, most ranges, sampled texts a range, and longest prefix that cuts.
RANGE_BYTES, RANGES, SAMPLED, PREFIX = 8 << 20, 16_384, 8, 256
#: Text of a trie, and texts whose digests a task remembers at once.
TRIE_BYTES, REMEMBERED = 8 << 20, 200_000

FILTERS = "ABCDE"
SAME = 1 << 4
CAPITALS = bytes(range(65, 91))
SYMBOL = re.compile(rb"[#$%&*|]")


def mask_of(body: bytes) -> int:
    """Failures A to D of a text."""
    words = body.split()
    points = len(body) if body.isascii() else len(body.decode("utf-8", "replace"))
    few = len(words) < 50
    alike = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(body) - len(body.translate(None, CAPITALS))) > 5 * points
    return few | alike << 1 | loud << 2 | (SYMBOL.search(body) is not None) << 3


class Trie:
    """A compressed trie of byte strings; a terminal holds the smallest id and what is to be flagged."""

    def __init__(self):
        self.root = [b"", {}, None, None]

    def insert(self, text: bytes) -> list:
        """The terminal of a text: [label, children, smallest id, documents]."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None, None]
                return child
            label = child[0]
            if not text.startswith(label, at):
                shared = common(label, text, at)
                branch = [label[:shared], {label[shared]: child}, None, None]
                child[0] = label[shared:]
                node[1][text[at]] = child = branch
            node, at = child, at + len(child[0])
        return node

    def terminals(self):
        open_ = [self.root]
        while open_:
            node = open_.pop()
            if node[3]:
                yield node
            open_.extend(node[1].values())


def common(label: bytes, text: bytes, at: int) -> int:
    """Length of what a label has in common with a text from a place on, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def cuts_of(sample: list[tuple[bytes, int]], ranges: int) -> list[bytes]:
    """Prefixes that cut sampled (start of a text, bytes) into ranges of about equal size."""
    sample = sorted(sample)
    total, done, cuts = sum(n for _, n in sample), 0, []
    for i, (start, n) in enumerate(sample):
        while i and len(cuts) < ranges - 1 and done >= total * (len(cuts) + 1) / ranges:
            last = sample[i - 1][0]
            same = common(last, start, 0)
            cuts.append(start[: same + 1])
        done += n
    return cuts


def range_of(cuts: list[bytes], start: bytes, digest: int) -> int:
    """The range of a text; texts of a prefix that fills several are dealt out by digest."""
    high = bisect_right(cuts, start)
    if not high:
        return 0
    low = bisect_left(cuts, cuts[high - 1])
    return low + 1 + digest % (high - low) if high - low > 1 else high


def masks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", range_bytes: int = RANGE_BYTES, trie_bytes: int = TRIE_BYTES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """(key, part, mask, n): how many rows of an id and a part have a mask of failures."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    own = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    size = F.octet_length("body").cast("bigint") + 1
    total, rows = own.agg(F.sum(size), F.count(F.lit(1))).first()
    ranges = max(1, min(RANGES, math.ceil((total or 0) / range_bytes)))
    every = max(1, rows // (SAMPLED * ranges))
    starts = own.filter(F.pmod(F.xxhash64("body"), F.lit(every)) == 0).groupBy(F.substring("body", 1, PREFIX).alias("start"), F.xxhash64("body").alias("h"))
    # about SAMPLED different texts a range, PREFIX bytes of each: 33 MB for the most ranges
    cuts = cuts_of([(bytes(r["start"]), r["n"]) for r in starts.agg(F.max(size).alias("n")).select("start", "n").collect()], ranges) if ranges > 1 else []
    shared_cuts = docs.sparkSession.sparkContext.broadcast(cuts)
    schema = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])

    def settle(batches):
        limits, least, failures = shared_cuts.value, {}, {}
        for batch in batches:
            if len(least) > remembered:
                least, failures = {}, {}
            keys, parts, bodies = (batch.column(i) for i in range(3))
            keys, parts = keys.to_pylist(), parts.to_pylist()
            digests, first = [], {}
            for i in range(batch.num_rows):
                whole = bodies[i].as_py()
                digest = blake2b(whole, digest_size=16).digest()
                digests.append(digest)
                if digest not in failures:
                    failures[digest] = mask_of(whole)
                if keys[i] is not None and (digest not in least or keys[i] < least[digest]):
                    least[digest] = keys[i]
                    first[digest] = i
            counts, unsettled = Counter(), Counter()
            for i, digest in enumerate(digests):
                row = keys[i], parts[i], digest
                if keys[i] is None:
                    counts[row, 0] += 1
                elif keys[i] > least[digest]:
                    counts[row, SAME] += 1
                else:
                    unsettled[row] += 1
                    first.setdefault(digest, i)
            out = [
                {"range": int.from_bytes(digest[:4], "big") % ranges, "key": k, "part": p, "mask": failures[digest] | same, "n": n, "body": None}
                for ((k, p, digest), same), n in counts.items()
            ]
            for (k, p, digest), n in unsettled.items():
                whole = bodies[first[digest]].as_py()
                at = range_of(limits, whole[:PREFIX], int.from_bytes(digest[:8], "big"))
                out.append({"range": at, "key": k, "part": p, "mask": failures[digest], "n": n, "body": whole})
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist(out[i : i + 1000], schema)

    sent = own.mapInArrow(settle, "range int, key bigint, part string, mask int, n bigint, body binary")
    dealt = sent.repartitionById(ranges, "range").sortWithinPartitions(F.col("body").asc_nulls_first()).select("key", "part", "mask", "n", "body")
    flat = pa.schema([schema.field(c) for c in ("key", "part", "mask", "n")])

    def flag(batches):
        trie, held, last = Trie(), 0, None

        def flagged():
            out = [(k, p, m | (SAME if k > node[2] else 0), n) for node in trie.terminals() for k, p, m, n in node[3]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), flat)], schema=flat)

        for batch in batches:
            ready = batch.filter(batch.column(4).is_null())
            if ready.num_rows:
                yield ready.select(["key", "part", "mask", "n"])
            if ready.num_rows == batch.num_rows:
                continue
            for k, p, m, n, whole in zip(*[c.to_pylist() for c in batch.columns]):
                if whole is None:
                    continue
                if held > trie_bytes and whole != last:
                    yield from flagged()
                    trie, held = Trie(), 0
                node = trie.insert(whole)
                node[2] = k if node[2] is None else min(k, node[2])
                node[3] = node[3] or []
                node[3].append((k, p, m, n))
                held += len(whole) + 200 if whole != last else 0
                last = whole
        yield from flagged()

    return dealt.mapInArrow(flag, "key bigint, part string, mask int, n bigint")


def cube(docs_masks: DataFrame, labels: DataFrame, label_key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, at most 32 rows a part."""
    marks = labels.filter(F.col(label_key).isNotNull()).groupBy(F.col(label_key).cast("bigint").alias("label_key")).agg(
        F.max(F.when(F.col(quality) == 1, 1).otherwise(0)).alias("good_"), F.max(F.when(F.col(toxic) == 1, 1).otherwise(0)).alias("toxic_")
    ).filter("good_ + toxic_ > 0")
    joined = docs_masks.join(marks, F.col("key") == F.col("label_key"), "left")
    counted = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(name) for c, name in (("good_", "good"), ("toxic_", "toxic"))]
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted)


def orders(counts: DataFrame) -> DataFrame:
    """The 600 lines of every part of a cube: all orders of the filters, step by step."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    lines = cells.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))).withColumn("step", F.explode(F.lit([1, 2, 3, 4, 5])))
    letter, earlier = F.expr("substr(filter_order, step, 1)"), F.expr("substr(filter_order, 1, step - 1)")
    own = sum((F.when(letter == f, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(F.contains(earlier, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    lines = lines.withColumn("own", own).withColumn("before", before)

    def total(which, amount) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("bigint"), lambda s, c: s + amount(c))

    def fails(c):
        return c["mask"].bitwiseAND(F.col("own")) != 0

    def gone(c):
        return c["mask"].bitwiseAND(F.col("before")) != 0

    def removed(c):
        return fails(c) & ~gone(c)

    return lines.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda c: ~fails(c) & ~gone(c), lambda c: c["n"]).alias("kept"),
        total(removed, lambda c: c["n"]).alias("removed"),
        total(lambda c: fails(c) & gone(c), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own"), lambda c: c["n"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        # of its k failures a document is removed by each first in 120 / k orders
        total(fails, lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """What every filter removes at every step of all orders, per part."""
    return orders(cube(masks(docs, **how), labels))
