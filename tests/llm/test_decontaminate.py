import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sluice.llm.decontaminate import FMIndex, benchmark_blocks, contamination, decontaminated
from sluice.llm.queries import QUERIES

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, size=10):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(text, items):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, body in items:
        for win in windows(body):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    found.add("" if item is None else str(item))
                    hit[i : i + len(win)] = [True] * len(win)
    return len(w), sum(hit), tuple(sorted(found))


PASSAGE = "One, two THREE four five six; seven eight nine ten eleven twelve été 13"


def cases():
    rng = random.Random(5)
    few = "one two three four five six seven eight nine ten".split()
    texts = [(i, " ".join(rng.choices(few, k=rng.randrange(0, 60)))) for i in range(40)]
    texts += [(50, f"before {PASSAGE} behind"), (51, f"{PASSAGE}\n{PASSAGE}"), (52, PASSAGE.upper()), (53, "short item here and shortitem"), (54, "zz")]
    items = [(1, PASSAGE), (2, "short item"), (3, None), (4, " ,.; "), (10, "zz"), (11, "one two three one two three one two three one two"), (1, PASSAGE), (None, "short item")]
    return texts, items


@pytest.fixture
def benchmark_table(spark):
    return lambda items: spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, key string")


def test_equal_to_brute_force(spark, documents, odd, benchmark_table, monkeypatch):
    texts, items = cases()
    texts = texts + odd
    expected = Counter((i, *brute(t, items)) for i, t in texts)
    found = lambda: Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in contamination(documents(texts), benchmark_table(items)).collect())
    assert found() == expected
    monkeypatch.setattr("sluice.llm.decontaminate.SHARD_BYTES", 300)  # many shards
    assert found() == expected


def test_blocks_of_the_benchmark_add_up(spark, documents, benchmark_table, monkeypatch):
    texts, items = cases()
    monkeypatch.setattr(benchmark_blocks, "__defaults__", ("item_id", "text", 40))
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in contamination(documents(texts), benchmark_table(items)).collect())
    assert found == Counter((i, *brute(t, items)) for i, t in texts)


def test_real_tables(spark):
    folder = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    by_window = {}
    for item, body in items:
        for w in windows(body):
            by_window.setdefault(w, set()).add(str(item))
    expected = {}
    for i, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = words(text)
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in by_window}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in by_window:
                    found |= by_window[tuple(w[k : k + size])]
                    hit[k : k + size] = [True] * size
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[i] = (len(w), sum(hit), len(found), sha, any(hit))
    rows = QUERIES["op5_decontamination"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == expected
    assert any(x[4] for x in expected.values())


def test_cut_texts_have_no_passage_left(spark, documents, odd, benchmark_table):
    texts, items = cases()
    cut = decontaminated(documents(texts + odd), benchmark_table(items[:1]))
    assert cut.columns == documents([]).columns
    rows = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (50, "before  behind") in rows and (51, "") in rows and set(odd) <= rows


def test_empty_tables(spark, documents, odd, benchmark_table):
    assert contamination(documents([]), benchmark_table([(1, "a")])).collect() == []
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in contamination(documents(odd), benchmark_table([])).collect())


def test_index_finds_every_place():
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.integers(1, 5, 400), [0], rng.integers(1, 5, 300), [0]])
    index = FMIndex(s)
    for size in (1, 2, 5):
        patterns = np.array([s[i : i + size] for i in rng.integers(0, 390, 30)] + [[7] * size])
        for p, a, b in zip(patterns, *index.search(patterns)):
            places = [i for i in range(len(s) - size + 1) if (s[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places
