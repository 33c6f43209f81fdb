import math
import re
from collections import Counter

import numpy as np
import pytest

from sluice.llm.toxicity import OrdinalModel, fit, fit_cumulative_link, score, sigmoid

FOLDER = "/root/testdata/sf0.1"  # enough labels of each kind to learn from one half


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = score(docs, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    right = np.mean([r["toxic"] == bool(r["truth"]) for r in rows])
    assert right >= 0.97
    bad, good = [r["severity"] for r in rows if r["truth"]], [r["severity"] for r in rows if not r["truth"]]
    # some toxic rows are repeated junk without any toxic word: ties count half
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= 0.96
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in rows)


def test_fit_recovers_an_ordinal_model():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    w, theta = np.array([2.0, -1.0, 0.0]), np.array([0.5, 2.0])
    grade = (rng.random((4000, 1)) > sigmoid(theta[None, :] - (x @ w)[:, None])).sum(axis=1)  # wrong if thresholds crossed
    u = rng.random(4000)[:, None]
    grade = (u > sigmoid(theta[None, :] - (x @ w)[:, None])).sum(axis=1)
    found_w, found_theta = fit_cumulative_link(x, grade, 2, ridge=0)
    assert np.allclose(found_w, w, atol=0.25) and np.allclose(found_theta, theta, atol=0.25)


def test_severity_is_the_expected_grade(spark, documents):
    model = OrdinalModel({b"bad": 3.0, b"worse": 2.0}, (1.0, 3.0))
    rows = {r["doc_id"]: r for r in score(documents([(1, "Bad bad WORSE!"), (2, "fine"), (3, None)]), model).collect()}
    below = 1 / (1 + np.exp(-(np.array([1.0, 3.0]) - 5)))
    assert rows[1]["severity"] == pytest.approx((1 - below).sum()) and rows[1]["grade"] == 2 and rows[1]["n_words"] == 3 and rows[1]["toxic"]
    assert rows[2]["severity"] == rows[3]["severity"] < 0.4 and not rows[2]["toxic"] and rows[3]["n_words"] == 0


def test_odd_rows_labels_and_empty_tables(spark, documents, odd):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    docs = documents(odd)
    assert fit(docs, labels([])) == OrdinalModel() == fit(docs, labels([(1, 1, 0), (2, 1, 0)])) == fit(documents([]), labels([(1, 1, 0), (2, 1, 1)]))
    model = fit(docs, labels([(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, 1, 0), (None, 1, 1), (7, 1, None), (99, 0, 1)]), least_chi2=0)
    assert len(score(docs, model).collect()) == len(odd)
    assert all(r["severity"] == 0 and not r["toxic"] for r in score(docs, OrdinalModel()).collect())
    assert score(documents([]), model).collect() == []


def brute_features(text):
    """Each word and each stem of four to eight letters of a longer word, with the number of different words that have it."""
    words = {w for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))}
    stems = [w[:n] + b"*" for w in words for n in (4, 5, 6, 7, 8) if len(w) > n]
    return {f: ([*words] + stems).count(f) for f in {*words, *stems}}


@pytest.mark.parametrize("least_chi2,max_features", [(10.0, 1500), (0.5, 40)])
def test_features_choice_and_severity_equal_the_definition(spark, odd, least_chi2, max_features):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, (_, t) in enumerate(odd, 1)], "doc_id bigint, text string"))
    model = fit(docs, labels, least_chi2=least_chi2, max_features=max_features)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {i: brute_features(t) for i, t in texts.items()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in texts}
    size = [sum(v == side for v in truth.values()) for side in (0, 1)]
    has = [Counter(f for i, v in truth.items() if v == side for f in found[i]) for side in (0, 1)]

    def chi2(f):
        share, apart = (has[0][f] + has[1][f]) / sum(size), has[1][f] / size[1] - has[0][f] / size[0]
        return apart * apart / max(share * (1 - share) * (1 / size[1] + 1 / size[0]), 1e-12)

    ranked = sorted(((-chi2(f), f) for f in has[0] | has[1] if chi2(f) >= least_chi2))[:max_features]
    assert len(ranked) > 5 and set(model.weights) == {f for _, f in ranked}
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    for r in score(docs, model).collect():
        z = sum(w * math.log2(1 + found[r["doc_id"]].get(f, 0)) for f, w in model.weights.items())
        above = [1, *(1 / (1 + math.exp(t - z)) for t in model.thresholds), 0]
        assert r["severity"] == pytest.approx(sum(above[1:]), abs=1e-9) and r["p_toxic"] == pytest.approx(above[1], abs=1e-9)
        chance = [a - b for a, b in zip(above, above[1:])]
        assert chance[r["grade"]] == pytest.approx(max(chance), abs=1e-9) and r["toxic"] == (r["p_toxic"] >= 0.5)
