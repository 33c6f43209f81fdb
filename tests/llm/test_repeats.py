import hashlib
import random
import re
from collections import Counter

import pytest

from sluice.llm import repeats
from sluice.llm.repeats import removal_digest, without_repeats


def marks(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        m = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                m[k : k + length] = b"\1" * length
        yield m


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (key, _), t, m in zip(rows, texts, marks(texts, length)):
        kept = bytes(b for b, x in zip(t, m) if not x)
        out[key, len(t), sum(m), sum(x and not (k and m[k - 1]) for k, x in enumerate(m)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def cases(seed=4):
    rng = random.Random(seed)
    some = lambda n, letters="abcdefghij é": "".join(rng.choices(letters, k=n))
    passage, long = some(90), some(300)
    rows = [(i, some(rng.randrange(0, 200)) + passage[rng.randrange(0, 40) : rng.randrange(50, 90)] + some(rng.randrange(0, 100))) for i in range(60)]
    rows += [(100 + i, some(20) + long + some(20)) for i in range(5)]
    rows += [(200, some(70) * 3), (201, "z" * 500), (202, "z" * 30 + some(40) + "z" * 45), (203, "ab" * 100), (204, some(40)), (205, some(39))]
    rows += [(210, some(30) + "-" * 38 + some(30)), (211, some(30) + "-" * 38 + some(30)), (212, some(9) + "-" * 40 + some(9)), (213, "-" * 60), (214, some(9) + "ab" * 20)]
    rows += [(215, "ba" * 20 + "b"), (216, some(3) + "abcdefg" * 6), (217, "cdefgab" * 6 + "zz"), (218, "x" * 45 + "y" * 45), (219, "abc" * 9 + "abd" * 9)]
    copy = some(150)
    rows += [(300 + i, copy) for i in range(7)] + [(310, copy[5:120]), (311, "q" * 39), (312, "q" * 39)]
    for i in range(8):  # near copies
        t = list(long)
        t[rng.randrange(len(t))] = "#"
        rows.append((400 + i, "".join(t)))
    rng.shuffle(rows)
    return rows


def found(df, **how):
    return Counter(tuple(r) for r in removal_digest(df, **how).collect())


@pytest.mark.parametrize("length,gram", [(40, 10), (41, 40), (50, 20)])
def test_equal_to_brute_force(spark, documents, odd, length, gram):
    rows = cases() + odd[:6]
    assert found(documents(rows).repartition(6), length=length, gram=gram) == brute(rows, length)


def test_long_and_odd_texts(spark, documents, odd):
    assert found(documents(odd)) == brute(odd, 400)


def test_small_buckets_and_crowded_anchors(spark, documents, monkeypatch):
    rows = cases(9)
    expected = brute(rows, 40)
    monkeypatch.setattr(repeats, "CONTEXTS", 7)
    assert found(documents(rows), length=40, gram=10) == expected
    real = repeats.removals
    monkeypatch.setattr(repeats, "removals", lambda *a: real(*a, crowd=2))  # nearly all anchors by counting
    assert found(documents(rows), length=40, gram=10) == expected


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows, 400)


def test_cut_texts_keep_whole_characters(spark, documents):
    same = "éà" * 120
    rows = [(1, "x" + same + "y"), (2, "a€" + same + "ö"), (3, None), (4, "own")]
    cut = without_repeats(documents(rows), length=50, gram=20)
    assert cut.columns == documents([]).columns
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == {(1, "xy"), (2, "a€ö"), (3, None), (4, "own")}
    half = [(1, "é" + "k" * 60), (2, "ũ" + "k" * 60)]  # the last bytes of é and ũ are the same
    assert {r["text"] for r in without_repeats(documents(half), length=60, gram=20).collect()} == {"é", "ũ"}


def without_passages(texts, length, words):
    """Plain texts (one byte a character) without strings of ``length`` and passages of ``words`` words that start twice."""
    places = [[m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", t)] for t in texts]
    parts = [[t[a:b] for a, b in at] for t, at in zip(texts, places)]
    count = Counter(tuple(p[k : k + words]) for p in parts for k in range(len(p) - words + 1))
    for t, at, p, mark in zip(texts, places, parts, marks([t.encode() for t in texts], length)):
        for k in range(len(p) - words + 1):
            if count[tuple(p[k : k + words])] > 1:
                first, last = at[k][0], at[k + words - 1][1]
                mark[first:last] = b"\1" * (last - first)
        yield "".join(c for c, x in zip(t, mark) if not x)


def test_passages_of_words_are_cut_however_short(spark, documents):
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 5))) for _ in range(n))
    passage, short, wide = some(60), some(50), " ".join("".join(rng.choices("xyz", k=9)) for _ in range(45))
    rows = [(i, some(20 + i) + "\n" + passage[: len(passage) - 7 * i] + " " + some(30)) for i in range(6)]
    rows += [(20, some(9) + "\t" + passage.replace(" ", "\n  ")), (21, "a" + passage + "b"), (22, short + " A " + short + " B"), (23, some(20) + " " + wide), (24, wide + " " + some(20))]
    rows += [(30, "at " * 51), (31, "at " * 52), (32, " at to" * 40), (33, "to at " * 25 + "C"), (34, some(51)), (35, some(51)), (None, some(70)), (None, some(3) + " same " + some(60))]
    rows += [(40, rows[-1][1]), (41, ""), (42, " \n"), (43, some(80)), (44, "x" * 399), (45, "x" * 399)]
    assert len(passage) < 400 < len(wide)
    expected = Counter(zip((k for k, _ in rows), without_passages([t for _, t in rows], 400, 51)))
    cut = without_repeats(documents(rows).repartition(5), words=51).select("doc_id", "text").collect()
    assert Counter(map(tuple, cut)) == expected
    assert (22, rows[8][1]) in expected and (20, "".join(rows[6][1].partition("\t")[:2])) in expected


@pytest.mark.parametrize("words", [5, 12])
def test_passages_equal_to_brute_force(spark, documents, words):
    rows = [(k, t.replace("é", "e").replace("j", " ").replace("i", "\n")) for k, t in cases(words)]
    expected = Counter(zip((k for k, _ in rows), without_passages([t for _, t in rows], 60, words)))
    cut = without_repeats(documents(rows).repartition(4), length=60, gram=20, words=words).select("doc_id", "text").collect()
    assert Counter(map(tuple, cut)) == expected


def test_passages_end_with_whole_words_and_characters(spark, documents):
    same = "é \U0001f600 ü ".strip() + " ö ñ"
    rows = [(1, "ä " + same + " x"), (2, "a\u00a0" + same + "\u3000y"), (3, "w\n" + same.replace(" ", "\r\n") + "\tz"), (4, None)]
    cut = without_repeats(documents(rows), length=50, gram=20, words=5)
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == {(1, "ä  x"), (2, rows[1][1]), (3, "w\n\tz"), (4, None)}


def test_empty_table(spark, documents):
    assert removal_digest(documents([])).collect() == []
    assert without_repeats(documents([])).collect() == []


def test_passages_of_no_rows(spark, documents):
    assert without_repeats(documents([]), words=51).collect() == []
    assert without_repeats(documents([(1, None), (2, ""), (None, "few words")]), words=51).count() == 3
