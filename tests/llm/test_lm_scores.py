import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from sluice.llm.lm_scores import _START, _UNKNOWN, DISCOUNT, cross_entropy_difference, fitted, marked, Models, Part

ROWS = [
    (1, "The cat sat. The cat ran!"), (2, "the dog sat"), (3, "a cat and the dog"), (4, None), (5, ""), (None, "the cat"), (6, "zebra"), (6, "zebra"),
    (7, "the cat sat " * 30), (8, "..."),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(rows, target, least_word, least_pair):
    """Scores from dictionaries of counts, by the definition."""
    corpora = [[words(t) for _, t in rows], [words(t) for k, t in rows if k in target]]
    uni = [Counter(w for d in c for w in d) for c in corpora]
    total = [sum(u.values()) for u in uni]
    share = lambda counts, x: sum(c[x] / n for c, n in zip(counts, total) if n) / sum(n > 0 for n in total)
    known = {w for w in uni[0] if share(uni, w) >= least_word}
    pairs = [Counter((a, b) for d in c for a, b in zip(["<s>", *d], d) if (a == "<s>" or a in known) and b in known) for c in corpora]
    kept = {p for p in pairs[0] if share(pairs, p) >= least_pair}
    scale = [total[1] / total[0] if total[1] else 1, 1]

    def probability(m, a, b):
        a, b = (x if x in known or x == "<s>" else "<unk>" for x in (a, b))
        counts = {**{w: uni[m][w] * scale[m] for w in known}, "<unk>": sum(v for w, v in uni[m].items() if w not in known) * scale[m]}
        alone = lambda w: (counts[w] + 1) / (sum(counts.values()) + len(counts))
        if a == "<unk>":
            return alone(b)
        context = len(corpora[m]) * scale[m] if a == "<s>" else counts[a]
        taken = {p: max(pairs[m][p] * scale[m] - DISCOUNT, 0) / max(context, 1e-9) for p in kept if p[0] == a}
        return taken.get((a, b), 0) + (1 - sum(taken.values())) * alone(b)

    for k, t in rows:
        w = words(t)
        if not w:
            yield k, 0, None, None, None
            continue
        loss = [sum(-math.log(probability(m, a, b)) for a, b in zip(["<s>", *w], w)) / len(w) for m in (0, 1)]
        yield k, len(w), loss[1], loss[0], loss[1] - loss[0]


@pytest.fixture
def keys(spark):
    return lambda ids: spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, n_words int")


@pytest.mark.parametrize("target,least_word,least_pair", [([1, 3], 0, 0), ([1, 3, None, 3, 99], 0.02, 0.01), ([], 0.01, 0.0)])
def test_equal_to_the_definition(spark, documents, keys, target, least_word, least_pair):
    found = [tuple(r) for r in cross_entropy_difference(documents(ROWS).repartition(3), keys(target), least_word=least_word, least_pair=least_pair).collect()]
    expected = list(brute(ROWS, {t for t in target if t is not None}, least_word, least_pair))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(found) == len(expected)
    for f, e in zip(sorted(found, key=order), sorted(expected, key=order)):
        assert f[:2] == e[:2] and f[2:] == pytest.approx(e[2:], abs=1e-9)


def test_models_sum_to_one(spark, documents, keys):
    rows = marked(documents(ROWS), keys([1, 3]), "doc_id", "text", 10)
    vocabulary, numbers = fitted(rows, 0.02, 0.01)
    models = Models(*numbers.value)
    size = len(vocabulary.value) + 2
    for m in (0, 1):
        for before in range(size):
            p = models.rest[m][before] * models.word[m]
            p[models.pairs[models.pairs >> 32 == before] & 0xFFFFFFFF] += models.pair[m][models.pairs >> 32 == before]
            assert p.sum() == pytest.approx(1) and (p >= 0).all()


def test_target_like_rows_score_lower(spark, documents, keys):
    rows = [(i, "red green blue red blue " * 5) for i in range(20)] + [(100 + i, "one two three two one " * 5) for i in range(20)]
    found = {r["doc_id"]: r["score"] for r in cross_entropy_difference(documents(rows), keys(range(10))).collect()}
    assert max(found[i] for i in range(20)) < min(found[100 + i] for i in range(20))


def test_empty_table(spark, documents, keys):
    assert cross_entropy_difference(documents([]), keys([1])).collect() == []


def test_every_target_row_counts(spark, documents, keys):
    rows = [(i, "alpha" if i % 3 else "beta") for i in range(20_500)]
    found = {r["doc_id"]: tuple(r)[2:] for r in cross_entropy_difference(documents(rows), keys(range(20_400))).collect()}
    for r in list(brute(rows, set(range(20_400)), 0, 0))[-3:]:
        assert found[r[0]] == pytest.approx(r[2:], abs=1e-9)


def test_pairs_seen_twice_count_in_a_large_corpus(spark, documents, keys):
    rows = [(i, "the cat sat " * 1000) for i in range(800)] + [(1000, "rare event"), (1001, "rare event"), (1002, "event rare")]
    found = {r["doc_id"]: r for r in cross_entropy_difference(documents(rows).repartition(3), keys([1000, 1001, *range(400)])).collect()}
    assert found[1000]["score"] == found[1001]["score"] < found[1002]["score"]
    for r in (r for r in brute(rows, {1000, 1001, *range(400)}, 0, 0) if r[0] >= 1000):
        assert tuple(found[r[0]])[2:] == pytest.approx(r[2:], abs=1e-9)


def test_parts_are_scored_alike(spark, documents, keys, monkeypatch):
    from sluice.llm import lm_scores

    whole = {(r["doc_id"], r["n_words"]): tuple(r)[2:] for r in cross_entropy_difference(documents(ROWS), keys([1, 3])).collect()}
    monkeypatch.setattr(lm_scores.marked, "__defaults__", (12,))
    parts = cross_entropy_difference(documents(ROWS).repartition(3), keys([1, 3])).collect()
    assert len(parts) == len(ROWS)
    for r in parts:
        assert tuple(r)[2:] == pytest.approx(whole[r["doc_id"], r["n_words"]], abs=1e-9)


def test_pairs_are_counted_in_little_memory():
    part, words = Part.__new__(Part), 300
    part.after = np.random.default_rng(5).integers(1, words, 1_000_000, np.int32)
    part.before = np.concatenate([np.zeros(1, np.int32), part.after[:-1]])
    number, tokens, hit = np.arange(words) + _START, np.ones(words, np.int64), part.after % 3 == 0
    number[7] = _UNKNOWN
    tracemalloc.start()
    try:
        cell, key, place, count, weight = part.pairs(number, tokens, 4, hit)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * len(part.after)
    known = [(a, b, h) for a, b, h in zip(part.before.tolist(), part.after.tolist(), hit.tolist()) if 7 not in (a, b)]
    every, target = Counter((a, b) for a, b, _ in known), Counter((a, b) for a, b, h in known if h)
    assert {(p >> 32, p & 0xFFFFFFFF): (n, m) for p, n, m in zip(place.tolist(), count.tolist(), weight.tolist())} == {p: (n, target[p]) for p, n in every.items()}
    assert sorted(zip(cell.tolist(), key.tolist())) == list(zip(cell.tolist(), key.tolist()))
    assert (key == (number[place >> 32] << 32 | number[place & 0xFFFFFFFF])).all()
