import math

import numpy as np
import pytest
from compare import database, of_spark, of_sql

from sluice.llm.queries import QUERIES, SQL
from sluice.llm.topk import products, top_k

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, place bigint, ids string, cell int"


def brute(rows, k=5):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(valid):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for n, (j, v) in enumerate(valid) if n != at)
        out += [(i, rank, None if missing else j, -s) for rank, (s, missing, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, vectors_, parts=3, **how):
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in vectors_], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in top_k(df, "vec_id % 50 = 0", **how).collect()), key=str)


SMALL = dict(query_rows=3, rows=4, held=2, streamed=2, fan=2)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, width)]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, SMALL], ids=["one tile", "many tiles and a deep tree"])
def test_equal_to_brute_force(spark, how):
    rows = vectors(260, 8)
    assert found(spark, rows, **how) == brute(rows)


def test_ties_repeats_and_rows_without_id(spark):
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot) for i in range(120)] + [(50, hot), (50, [1.0, 1.0, 1.0]), (None, hot), (None, [2.0, 0.0, 0.0]), (7, hot), (-50, hot)]
    assert found(spark, rows, **SMALL) == brute(rows)
    assert found(spark, rows, k=200, **SMALL) == brute(rows, 200)


def test_vectors_that_take_no_part_and_odd_lengths(spark):
    rows = [
        (0, None), (50, [1.0, None]), (100, [1.0, float("nan")]), (150, [float("inf"), 1.0]), (200, [1.0, 2.0]), (250, []), (300, [0.5]),
        (1, [3.0, 1.0, 5.0]), (2, [-1.0, -1.0]), (3, []), (4, None),
    ]
    assert found(spark, rows, **SMALL) == brute(rows)


def test_fewer_rows_than_asked_for_and_no_rows(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (3, [2.0])]) == [(0, 1, 3, 256 * 512)]
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 2.0]), (2, [2.0**20, 3.0]), (50, [2.0**15, 0.5])]
    assert found(spark, rows) == brute(rows)
    q, c = np.array([[3, 1 << 20]]), np.array([[5, 1 << 30]])
    assert products(q, 1 << 20, c, 1 << 30).tolist() == [[15 + (1 << 50)]]
    with pytest.raises(ArithmeticError):
        products(q, 1 << 40, c, 1 << 40)


def test_wide_vectors_are_packed_into_smaller_blocks(spark):
    rows = vectors(12, 3) + [(1000 + i, [0.01 * i] * 400_000) for i in range(4)]
    assert found(spark, rows, parts=1) == brute(rows)


def test_query_equals_sql(spark):
    assert of_spark(QUERIES["op11_topk_search"](spark, FOLDER)) == of_sql(database(FOLDER), SQL["op11_topk_search"])
