import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

from compare import database, of_spark, of_sql
from pyspark.sql import functions as F

from sluice.llm.conversations import Stack, audited, damaged, repaired
from sluice.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, pass_ int, at string, here int, conv string"
LEGAL, OPEN = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, text


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not own else 2 if (role, text) in seen else 0 if own[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits, tried one after the other: (cost, letters, repaired turns)."""
    marks = faults(rows)

    @cache
    def least(at, initials, inserted):
        options = [(0, "", ())] if at == len(rows) and LEGAL.fullmatch(initials) else []

        def take(cost, letter, to, more, *turn):
            grown = initials + turn[0][:1] if turn else initials
            if not turn or turn[0] and OPEN.fullmatch(grown):
                # what pairs came before makes no difference but for the first
                c, letters, texts = least(to, re.sub("^(s?)(ua)+(ua)", r"\1\3", grown), more)
                options.append((cost + c, letter + letters, (":".join(turn), *texts) if turn else texts))

        if at < len(rows):
            _, role, text = rows[at]
            take(2, "D", at + 1, 0)
            if marks[at] in (0, 3):
                extra = 5 if marks[at] else 0
                take(extra, "K", at + 1, 0, role, text)
                for other in ("user", "assistant"):
                    take(1 + extra, "R", at + 1, 0, other, text)
        if inserted < 3:
            for other in ("user", "assistant"):
                take(5, "I", at, inserted + 1, other, "")
        return min(options, default=(10**9, "", ()))

    return least(0, "", 0)


def summary(rows):
    rows = sorted(rows, key=order)
    marks = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, texts = cheapest(tuple(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, marks.count(1), marks.count(2), marks.count(3), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def brute(rows, damage=hurt):
    left = damage(rows)
    return Counter((c, *summary([r[1:] for r in left if r[0] == c])) for c in {r[0] for r in rows})


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(parts)


def found(spark, rows, **how):
    return Counter(tuple(r) for r in audited(damaged(frame(spark, rows)), F.col("here"), **how).collect())


def drawn(n, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "u", ""], ["Yes.", "No!", "cut", "", " \t", "Why?\n", "é…", "ok. \x0b"]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in rng.sample(range(9), rng.randint(1, 6))]


def test_equal_to_all_edits(spark):
    rows = drawn(300, 5)
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [
        (None, 1, "user", "Null."), (None, None, None, None), (None, None, "assistant", "A."), (7, 2, "user", "Same."), (7, 2, "user", "Same."),
        (7, 2, "assistant", "Other."), (7, 9, None, "x."), (8, None, "user", None), (9, 3, "user", "w " * 100_000 + "."), (9, 4, "assistant", "word? " * 30_000),
        (-1, -5, "system", "S."), (-1, 5, "user", "門 😀?"), (2**60, 2**61, "user", "Big."), (2**60, 2**61 + 1, "assistant", "Id."),
    ]
    assert found(spark, rows) == brute(rows)


def test_conversations_without_rows_left_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(gone, 0, "user", "Gone.")]) == Counter([(gone, 0, 0, 0, 0, 0, 0, "", nothing)])
    assert found(spark, []) == Counter()


def test_a_giant_conversation_is_spilled_and_equal_to_its_pieces(spark):
    # legal turns with one fault each 1000: every piece is repaired by itself
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 1000 else f"cut {t}") for t in range(150_000)]
    df = frame(spark, rows, 8).select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    (one,) = audited(df, spill=1000).collect()
    assert one["truncated"] == 150 and one["illegal"] == 0 and one["gaps"] == 0
    # a cut user turn goes with the answer before it, for 4 where keeping it costs 5; the first goes with its own
    gone = {0, 1, *(t for t in range(2, 149_999) if t % 1000 in (0, 999))}
    assert one["cost"] == 150 * 4 and one["audit"] == "".join("D" if t in gone else "K" for t in range(150_000))
    turns = [f"{r}:{x}" for _, t, r, x in rows if t not in gone]
    assert one["repaired_sha256"] == hashlib.sha256("\n".join(turns).encode()).hexdigest()


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = drawn(60, 9)
    left = damaged(frame(spark, rows))
    turns = repaired(left, F.col("here")).collect()
    for r in audited(left, F.col("here")).collect():
        own = sorted((t for t in turns if t["conv"] == r["conv"]), key=lambda t: t["place"])
        assert "".join(t["edit"] for t in own) == r["audit"]
        kept = [t for t in own if t["edit"] != "D"]
        assert LEGAL.fullmatch("".join(t["role"][0] for t in kept))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in kept).encode()).hexdigest() == r["repaired_sha256"]


def test_stack_is_last_in_first_out():
    stack, rng = Stack(1000), random.Random(2)
    pushed = [rng.randrange(256) for _ in range(200_000)]
    for x in pushed:
        stack.push(x)
    assert [stack.pop() for _ in pushed] == pushed[::-1]
    stack.close()


def test_query_equals_sql(spark):
    assert of_spark(QUERIES["op12_conversation_repair"](spark, FOLDER)) == of_sql(database(FOLDER), SQL["op12_conversation_repair"])
