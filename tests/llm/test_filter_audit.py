import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from compare import database, of_spark, of_sql

from sluice.llm.filter_audit import Trie, cuts_of, interactions, mask_of, masks, range_of
from sluice.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TIGHT = dict(range_bytes=500, trie_bytes=300, remembered=3)


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        *("A" if len(words) < 50 else ""), *("B" if 100 * len(set(words)) < 65 * len(words) else ""),
        *("C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""), *("D" if re.search(r"[#$%&*|]", text) else ""),
    }


def brute(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = [(i, p or "", failures(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())) for i, t, p in rows]
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, x in labels if i is not None and x == 1}
    out, shapley = [], defaultdict(int)
    for part in {p for _, p, _ in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                own = [d for d in docs if d[1] == part and f in d[2]]
                shapley[part, f] += len(hit)
                out.append((part, "".join(order), step, len(left), len(hit), len(own) - len(hit), sum(d[2] == {f} for d in own),
                            sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit), f))
    return Counter((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def found(spark, rows, labels, parts=3, **how):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id bigint, text string, source string, mask int, n int, part string, key string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return Counter(tuple(r) for r in interactions(docs.repartition(parts), marks, **how).collect())


def drawn(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "short", "SHORT", "a # b", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 30}" for i in range(60)), "shared " * 60 + "x", "shared " * 60 + "y",
             "Word " * 80, "é" * 30, " ".join(f"W{i}" for i in range(70)) + " 100%", "shared", "门 " * 70, "l" * 3000]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, TIGHT], ids=["one range", "many ranges and tries"])
def test_equal_to_the_definition(spark, how):
    rows = drawn(250, 3)
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 250, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    assert found(spark, rows, labels, **how) == brute(rows, labels)


def test_odd_rows_and_an_empty_table(spark, odd):
    rows = [(i, t, "s") for i, t in odd]
    assert found(spark, rows, [], **TIGHT) == brute(rows, [])
    assert found(spark, [], [(1, 1, 1)]) == Counter()


def test_a_text_or_an_id_on_a_third_of_all_rows(spark):
    rows = [(i, "copied text " * 20, "a") for i in range(1500, 0, -1)] + [(77, f"own text {i}", "b") for i in range(1500)] + [(i, f"t{i}", None) for i in range(3000, 4500)]
    labels = [(77, 1, 0), (1500, 0, 1)]
    assert found(spark, rows, labels, parts=8) == brute(rows, labels)
    assert found(spark, rows, labels, parts=8, **TIGHT) == brute(rows, labels)


def test_copies_are_settled_without_their_texts(spark):
    df = spark.createDataFrame([(i, "the same text " * 500, "s") for i in range(3000)], "doc_id bigint, text string, source string").coalesce(2)
    plan = masks(df)
    assert Counter((r["mask"] >> 4, r["n"]) for r in plan.collect()) == Counter({(1, 1): 2999, (0, 1): 1})


def test_tries_hold_every_text_once():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    trie = Trie()
    for i, t in enumerate(texts):
        node = trie.insert(t)
        node[2] = i if node[2] is None else min(i, node[2])
        node[3] = [*(node[3] or []), t]
    seen = {node[3][0]: node for node in trie.terminals()}
    assert set(seen) == set(texts)
    assert all(node[2] == texts.index(t) and set(node[3]) == {t} and len(node[3]) == texts.count(t) for t, node in seen.items())


def test_ranges_are_even_and_keep_equal_texts_together():
    rng = random.Random(6)
    starts = [b"license " * 20 if i % 3 == 0 else bytes(rng.choice(b"abcdef") for _ in range(12)) for i in range(3000)]
    cuts = cuts_of([(s, 100) for s in starts[:600]], 12)
    digests = [rng.getrandbits(64) for _ in starts]
    at = [range_of(cuts, s, d) for s, d in zip(starts, digests)]
    sizes = Counter(at)
    assert set(sizes) <= set(range(12)) and max(sizes.values()) < 2 * 3000 / 12
    assert all(range_of(cuts, s, d) == a for s, d, a in zip(starts, digests, at))
    assert max(len(c) for c in set(cuts) - {b"license " * 20}) < 8
    assert cuts_of([], 5) == [] and range_of([], b"x", 3) == 0


def test_masks_of_single_texts():
    for text in ["", " ", "A", "a b", "w " * 50, "É" * 10 + "A", "|", "\x0b\x0cx", "AB" + "c" * 38, "AB" + "c" * 37]:
        assert mask_of(text.encode()) == sum(1 << "ABCD".index(f) for f in failures(text)), text


def test_query_equals_sql(spark):
    assert of_spark(QUERIES["op13_filter_audit"](spark, FOLDER)) == of_sql(database(FOLDER), SQL["op13_filter_audit"])
