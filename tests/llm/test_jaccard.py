import random
from collections import Counter

import numpy as np
import pytest

from sluice.llm import jaccard
from sluice.llm.common import keyed_text
from sluice.llm.jaccard import component_ids
from sluice.llm.links import components


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows):
    """key, number of shingles and smallest key of the component, for every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def found(df, **how):
    return Counter(tuple(r) for r in component_ids(df, **how).collect())


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows, key = [], 100
    for group in (3, 40, 5, 2):  # groups of near copies, also chains
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(group):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((key, " ".join(text)))
            key += 1
            if rng.random() < 0.3:
                base = text
    for _ in range(60):  # one passage in texts that differ
        own = [word() for _ in range(rng.randrange(5, 80))]
        rows.append((key, " ".join(own + passage)))
        key += 1
    for n in range(1, 14):  # short sets
        rows += [(key, " ".join(passage[:n])), (key + 1, " ".join(passage[:n]).upper())]
        key += 2
    rng.shuffle(rows)
    return rows


def test_equal_to_all_pairs(spark, documents, odd):
    rows = near_copies() + odd
    assert found(documents(rows).repartition(5)) == brute(rows)


@pytest.mark.parametrize("every,members,bits", [(1, 3, 27), (5, 2, 8)])
def test_sampling_and_group_size_do_not_change_the_result(spark, documents, monkeypatch, every, members, bits):
    rows = near_copies(7)
    monkeypatch.setattr(jaccard, "_MEMBERS", members)
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(jaccard, "MAP_BITS", bits)
    assert found(documents(rows), every=every) == brute(rows)


@pytest.mark.parametrize("run,cell", [(1 << 21, 8 << 20), (50, 64)])
def test_all_rows_tell_which_ngrams_are_frequent(spark, documents, odd, monkeypatch, run, cell):
    """30 rows make an n-gram frequent here, wherever in the table they stand and whether or not their keys are null or repeat."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = list(odd)
    for times in (1, 3, 28, 29, 30, 31, 100):
        passage = " ".join(word() for _ in range(8))
        rows += [(rng.choice([None, 7, 1000 + len(rows)]), f"{passage} {word()} {passage}") for _ in range(times)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(jaccard, "RUN_GRAMS", run, raising=False)
    monkeypatch.setattr(jaccard, "CELL_BYTES", cell, raising=False)
    sets = jaccard.ngram_sets([t and t.encode() for _, t in rows], jaccard.WordHashes())
    counts = Counter(h for s in sets for h in s.tolist())
    assert {28, 29, 30, 31, 100} <= set(counts.values())
    bits = jaccard.frequent_ngrams(keyed_text(documents(rows).repartition(3)), 4, 10)
    marked = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    assert marked.tolist() == sorted({h >> (64 - jaccard.MAP_BITS) for h, n in counts.items() if n >= 30})


def test_product_alone_finds_every_link(spark, documents, monkeypatch):
    """Without contraction: no pair of near copies is settled before the product."""
    rows = near_copies(3)
    real, calls = jaccard.linked, []

    def none_first(texts, classes, pairs, size):
        calls.append(1)
        return real(texts, classes, pairs.limit(0) if len(calls) == 1 else pairs, size)

    monkeypatch.setattr(jaccard, "linked", none_first)
    assert found(documents(rows)) == brute(rows)
    assert len(calls) == 2


def test_empty_and_wordless_tables(spark, documents):
    assert component_ids(documents([])).collect() == []
    assert found(documents([(1, None), (2, ""), (3, " ")])) == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3)])


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    names = list(range(120))
    rng.shuffle(names)
    links = spark.createDataFrame([(names[i], names[i + 1]) for i in range(99)] + [(names[110], names[111])] * 3, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    first = min(names[:100])
    assert got == {**{n: first for n in names[:100]}, **{n: min(names[110:112]) for n in names[110:112]}}
