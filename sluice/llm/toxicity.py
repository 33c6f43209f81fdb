"""Toxicity by cumulative-link ordinal regression.

Severity is a grade from 0 to K.  One weight per word is shared by all grades
and an ordered row of thresholds cuts the score: P(grade <= k) =
sigmoid(theta_k - w.x).  The expected severity is the sum of P(grade > k) over
k.  x is sparse: for each word, and each beginning of 4 to 8 bytes of longer
words (written with a star), log2(1 + the number of the text's different words
that have it), so that inflected and compound words count with their stem.

The model is fitted on the driver to a bounded sample of labelled rows: the
``per_class`` rows with the lowest hashed keys of each class (default 1,500),
and the ``max_features`` features whose presence tells the classes apart best
(chi-square above ``least_chi2``).  Everything is scored: words are the maximal runs of
ASCII letters and characters outside ASCII, lower-cased in ASCII.

Binary labels carry no grades, so toxic rows of the sample are graded by how
many tell-tale features they have, in K equal parts (ties share the
lower grade); rows labelled clean have grade 0.

Null and empty texts have no words and get the severity of the thresholds
alone.  Labels that are null or have no document are left out; of labels
that contradict each other the toxic one counts.  Without rows of both classes every
severity is 0.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import LETTERS, keyed_text, schema_with_key


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised, weighted likelihood (Adam on all rows at once).

    Thresholds stay ordered as a first one plus exponentials of gaps.
    """
    n, m = x.shape
    w, first, gaps = np.zeros(m), np.zeros(1), np.zeros(grades - 1)
    parts = [w, first, gaps]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    rows = np.arange(n)
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    for t in range(1, rounds + 1):
        theta = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        below = np.hstack([np.zeros((n, 1)), sigmoid(theta[None, :] - (x @ w)[:, None]), np.ones((n, 1))])
        p = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        slope = below * (1 - below)
        upper, lower = weight * slope[rows, grade + 1] / p, weight * slope[rows, grade] / p
        d_theta = np.zeros(grades + 2)
        np.add.at(d_theta, grade + 1, -upper)
        np.add.at(d_theta, grade, lower)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        slopes = [x.T @ (upper - lower) + ridge * w, np.array([tail[0]]), tail[1:] * np.exp(gaps)]
        for i, (part, g) in enumerate(zip(parts, slopes)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            part -= 0.05 * mean[i] / (1 - 0.9**t) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
    return w, first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(LETTERS).split() if body else []


_STEMS = range(4, 9)


def features_of(words: list[bytes], known: frozenset[bytes] | None = None) -> Counter:
    """Features of a text, of the known ones or all, and how many different words have each."""
    distinct = set(words)
    found = Counter(distinct if known is None else known.intersection(distinct))
    for n in _STEMS:
        stems = [w[:n] + b"*" for w in distinct if len(w) > n]
        found.update(stems if known is None else filter(known.__contains__, stems))
    return found


def fit(
    docs: DataFrame, labels: DataFrame, grades: int = 3, per_class: int = 1500, max_features: int = 1500, least_chi2: float = 25.0,
    key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> OrdinalModel:
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("toxic"))
    rank = [F.xxhash64("key"), F.col("key")]
    chosen = known.filter("toxic = 1").orderBy(*rank).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*rank).limit(per_class))
    sample = keyed_text(docs, key, text).join(F.broadcast(chosen), "key").dropDuplicates(["key"])  # at most 2 * per_class rows

    def features(batches):
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(features_of(words_of(body)).items())
                names, sizes = [f for f, _ in found], [n for _, n in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic], pa.int32()), pa.array([names], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int32()))], names=["toxic", "names", "sizes"]
                )

    rows = sample.select("body", F.col("toxic").cast("int")).mapInArrow(features, "toxic int, names array<binary>, sizes array<int>").toArrow()
    toxic = rows.column("toxic").to_numpy().astype(bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return OrdinalModel()
    listed = rows.column("names").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    names, codes, sizes = coded.dictionary.to_pylist(), coded.indices.to_numpy(), rows.column("sizes").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), listed.value_lengths().to_numpy())
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    with1, with0 = (np.bincount(codes[toxic[row] == side], minlength=len(names)) for side in (True, False))
    share = (with1 + with0) / (n1 + n0)
    chi2 = (with1 / n1 - with0 / n0) ** 2 / np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12)
    strong = sorted(np.flatnonzero(chi2 >= least_chi2), key=lambda i: (-chi2[i], names[i]))[:max_features]
    column = {int(f): j for j, f in enumerate(strong)}
    place = np.full(len(names), -1)
    place[list(column)] = list(column.values())
    x = np.zeros((len(toxic), len(strong)))
    own = place[codes] >= 0
    x[row[own], place[codes[own]]] = np.log2(1 + sizes[own])
    telling = x[:, [j for f, j in column.items() if with1[f] / n1 > with0[f] / n0]].sum(axis=1)
    cuts = np.quantile(telling[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + (telling[:, None] > cuts[None, :]).sum(axis=1), 0)
    w, theta = fit_cumulative_link(x, grade, grades, np.where(toxic, 1 / n1, 1 / n0))  # both classes count alike
    return OrdinalModel({names[f]: float(w[j]) for f, j in column.items()}, tuple(theta.tolist()))


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", flag_from: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: key, n_words, severity (expected grade), grade (most probable), p_toxic, toxic (p_toxic >= flag_from)."""
    rows = keyed_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def scored(batches):
        weights, theta = shared.value[0], np.array(shared.value[1])
        known = frozenset(weights)
        for batch in batches:
            n_words, total = [], []
            for body in batch.column(1).to_pylist():
                words = words_of(body)
                n_words.append(len(words))
                found = features_of(words, known)
                total.append(sum(weights[f] * math.log2(1 + found[f]) for f in sorted(found)))
            above = 1 - sigmoid(theta[None, :] - np.array(total)[:, None])  # P(grade > k)
            full = np.hstack([np.ones((len(total), 1)), above, np.zeros((len(total), 1))])
            p = above[:, 0] if len(theta) else np.zeros(len(total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(above.sum(axis=1)), pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1), pa.int32()), pa.array(p), pa.array(p >= flag_from)],
                names=[key, "n_words", "severity", "grade", "p_toxic", "toxic"],
            )

    return rows.mapInArrow(scored, schema_with_key(rows, key, "n_words bigint, severity double, grade int, p_toxic double, toxic boolean"))
