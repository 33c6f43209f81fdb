"""Sequencing masks, index codes and flow cells as column expressions.

A mask such as ``y*,i8n*,i8,y100`` says per read how many cycles are used
(``y`` or ``i``) and then ignored (``n``); ``*`` stands for all that are left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import bind, col

# The formats of masks and codes, the name of an empty code, joined workflow types.
PARTS = ("read_one", "read_one_ignored", "index_one", "index_one_ignored", "index_two", "index_two_ignored", "read_two", "read_two_ignored")
TOKEN = r"([yin](?:\*|[0-9]+)|,)"
SEGMENT = r"([iIyYnN])\s*(\*|[0-9]*)"
CODE = r"(?i)\A([ACGT]+)(?:-([ACGT]+))?\z"
NO_INDEX = "NoIndex"
ALL = 2**31 - 1
JOINED = ("NovaSeqStandard", "OnBoardClustering", "HISEQ_ONBOARD")


def parse_mask(text: Column | str) -> Column:
    """Struct of the eight cycle counts (``ALL`` for a star, empty for none or 0), or empty if the text is no mask.

    The text is read token by token.  There are four reads: first, two
    indices, last.  A comma moves on by one; ``y`` stands in the first read and
    in the last, ``i`` in an index; ``n`` follows in the same read, or begins
    one.  A count that finds its place taken, or out of its read, moves on to
    the next read that can have it (from the first read to the second index,
    since the first needs its comma).
    """
    t = F.lower(col(text))
    tokens = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))
    start = F.struct(F.lit(0).alias("read"), F.lit(True).alias("good"), F.array(*[F.lit(None).cast("string")] * len(PARTS)).alias("counts"))

    def free(state: Column, place: Column) -> Column:
        return F.get(state["counts"], place).isNull()

    def step(state: Column, token: Column) -> Column:
        read, letter = state["read"], F.substring(token, 1, 1)
        begun = ~free(state, F.lit(0))
        both = free(state, 2 * read) & free(state, 2 * read + 1)
        after = F.when(read < 2, 2).otherwise(read + 1)
        to = (
            F.when(letter == ",", read + 1).when(letter == "y", F.when(begun, 3).otherwise(0))
            .when(letter == "i", F.when(read.isin(1, 2) & both, read).when(read < 2, 2).otherwise(4))
            .otherwise(F.when(free(state, 2 * read + 1), read).otherwise(after))
        )
        place = 2 * to + F.when(letter == "n", 1).otherwise(0)
        fits = F.when(letter == ",", True).when(letter == "n", free(state, place)).otherwise(free(state, 2 * to) & free(state, 2 * to + 1))
        good = state["good"] & (to < 4) & (begun | (letter == "y")) & fits
        counts = F.transform(state["counts"], lambda x, i: F.when((i == place) & (letter != ","), F.substring(token, 2, F.length(token))).otherwise(x))
        return F.struct(F.least(to, F.lit(3)).alias("read"), good.alias("good"), counts.alias("counts"))

    def part(counts: Column, i: int) -> Column:
        return F.when(counts[i] == "*", F.lit(ALL)).otherwise(F.nullif(counts[i].try_cast("int"), F.lit(0)))

    def read_out(state: Column) -> Column:
        whole = state["good"] & ~F.get(state["counts"], F.lit(0)).isNull()
        return F.when(whole, F.struct(*[part(state["counts"], i).alias(name) for i, name in enumerate(PARTS)]))

    return F.when(F.array_join(tokens, "") == t, F.aggregate(tokens, start, step, read_out))


def write_mask(mask: Column) -> Column:
    """The text of a mask."""

    def one(letter: str, name: str) -> Column:
        n = mask[name]
        return F.when(n.isNull(), F.lit("")).when(n == ALL, F.lit(f"{letter}*")).otherwise(F.concat(F.lit(letter), n.cast("string")))

    def read(letter: str, name: str) -> Column:
        return F.concat(one(letter, name), one("n", f"{name}_ignored"))

    later = [F.nullif(read(*p), F.lit("")) for p in (("i", "index_one"), ("i", "index_two"), ("y", "read_two"))]
    return F.when(mask.isNotNull(), F.concat_ws(",", read("y", "read_one"), *later))


def parse_code(text: Column | str) -> Column:
    """Struct of the first and second (or empty) index, upper case; no index has an empty first one; empty if unparseable."""
    t = col(text)
    none = t.isNull() | t.isin("", NO_INDEX)
    one, two = F.upper(F.regexp_extract(t, CODE, 1)), F.nullif(F.upper(F.regexp_extract(t, CODE, 2)), F.lit(""))
    return F.when(none, F.struct(F.lit("").alias("one"), F.lit(None).cast("string").alias("two"))).when(t.rlike(CODE), F.struct(one.alias("one"), two.alias("two")))


def write_code(code: Column) -> Column:
    return F.concat_ws("-", code["one"], code["two"])


def code_length(code: Column) -> Column:
    """The name of a code's lengths: ``8``, ``8x6`` or ``NoIndex``."""
    lengths = F.concat_ws("x", F.length(code["one"]).cast("string"), F.length(code["two"]).cast("string"))
    return F.when(code["one"] == "", F.lit(NO_INDEX)).otherwise(lengths)


def trim_code(code: Column, mask: Column) -> Column:
    """What a mask leaves of a code; empty if it leaves nothing of a code that had an index."""

    def cut(index: str, name: str) -> Column:
        n = mask[name]
        return F.when(n.isNotNull(), F.nullif(F.substring(code[index], F.lit(1), n), F.lit("")))

    def joined(one: Column, two: Column) -> Column:
        left = F.struct(F.coalesce(one, two).alias("one"), F.when(one.isNotNull(), two).alias("two"))
        return F.when(code["one"] == "", code).when(one.isNotNull() | two.isNotNull(), left)

    return joined(cut("one", "index_one"), cut("two", "index_two"))


def narrowed_mask(code: Column, mask: Column) -> Column:
    """The run's mask with the indexes cut to a (trimmed) code: what is behind them is ignored."""

    def index(name: str, part: Column) -> list[Column]:
        size = F.nullif(F.length(part), F.lit(0))
        has = mask[name].isNotNull()
        ignored = F.coalesce(mask[f"{name}_ignored"], F.when(has & (size.isNotNull() | mask["index_one"].isNotNull()), F.lit(ALL)))
        return [F.when(has, size).alias(name), ignored.alias(f"{name}_ignored")]

    return F.struct(
        mask["read_one"], mask["read_one_ignored"], *index("index_one", code["one"]), *index("index_two", code["two"]), mask["read_two"], mask["read_two_ignored"]
    )


def parse_bases_mask(text: Column | str) -> Column:
    """Segments of a mask: group, position in it, type, length (-1 for a star), cycles, and how often the type came before."""
    groups = F.transform(F.split(col(text), ","), lambda g, i: F.struct(F.trim(g).alias("g"), i.cast("bigint").alias("i")))

    def segments(group: Column) -> Column:
        kinds, counts = F.regexp_extract_all(group["g"], F.lit(SEGMENT), F.lit(1)), F.regexp_extract_all(group["g"], F.lit(SEGMENT), F.lit(2))
        return F.transform(kinds, lambda k, p: F.struct(
            group["i"].alias("group"), F.when(F.get(counts, p) == "*", F.lit(-1)).otherwise(F.get(counts, p).cast("bigint")).cast("bigint").alias("length"),
            p.cast("bigint").alias("position"), F.upper(k).alias("type"),
        ))

    empty = F.array().cast("array<struct<cycle_end:bigint,cycle_start:bigint,group:bigint,length:bigint,ordinal:bigint,position:bigint,type:string>>")

    def add(done: Column, s: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["cycle_end"], F.lit(0).cast("bigint"))
        end = F.when((s["length"] < 0) | (start < 0), F.lit(-1).cast("bigint")).otherwise(start + s["length"])
        ordinal = F.size(F.filter(done, lambda d: d["type"] == s["type"])).cast("bigint")
        return F.array_append(done, F.struct(
            end.alias("cycle_end"), start.alias("cycle_start"), s["group"], s["length"], ordinal.alias("ordinal"), s["position"], s["type"]
        ))

    return F.aggregate(F.flatten(F.transform(groups, segments)), empty, add)


def convert_mask(segment: Column) -> Column:
    """A parsed segment without what packing does not need."""
    return F.struct(segment["group"].alias("group"), segment["length"].alias("length"), segment["position"].alias("position"), segment["type"].alias("type"))


def pack_bases_mask(segments: Column | str) -> Column:
    """The mask of converted segments: groups in order, each in order of position."""
    ordered = F.sort_array(F.transform(col(segments), lambda s: F.struct(s["group"].alias("g"), s["position"].alias("p"), s["length"].alias("n"), s["type"].alias("t"))))

    def text(s: Column) -> Column:
        letter = F.when(s["t"] == "", F.lit("N")).otherwise(F.upper(F.substring(s["t"], 1, 1)))
        return F.concat(letter, F.when(s["n"] > 0, s["n"].cast("string")).otherwise(F.lit("*")))

    def joined(all_: Column) -> Column:
        groups = F.array_distinct(F.transform(all_, lambda s: s["g"]))
        return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(F.filter(all_, lambda s: s["g"] == g), text), "")), ",")

    return bind(ordered, joined)


def flowcell_geometry(lanes: Column | str, joined: Column | str) -> Column:
    """Lanes that may be merged: all of them, or each by itself."""
    numbers = F.sequence(F.lit(1).cast("bigint"), col(lanes).cast("bigint"))
    return F.when(col(joined), F.array(numbers)).otherwise(F.transform(numbers, lambda n: F.array(n)))


def is_workflow_type_joined(workflow: Column | str) -> Column:
    return col(workflow).isin(*JOINED)
