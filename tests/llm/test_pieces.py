import math
import random
from collections import Counter

import numpy as np
import pytest

from sluice.llm.lattice import PieceTable, endings
from sluice.llm.pieces import load_pieces
from sluice.llm.sampled_pieces import decode_pieces, encode_sampled, sample_rows
from sluice.llm.token_counts import token_counts

WORDS = ["the", "Ertionan", "▁", "▁▁b", "門外漢", "\U0001f600!", "x" * 400, "naïveté", "don't", "123456", "thththth", "á"]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


def viterbi(word, pieces):
    """Tokens of the best segmentation of a whole pre-token, fewest on ties."""
    word = " " + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - pieces.longest), end):
            if word[start:end] in pieces.score:
                options.append((best[start][0] + pieces.score[word[start:end]], best[start][1] - 1))
        if word[end - 1] not in pieces.score:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * pieces.byte_score, best[end - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


def spaced(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_counts_equal_a_plain_forward_pass(spark, documents, odd, pieces):
    rng = random.Random(3)
    texts = odd + [(20 + i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 40)))) for i in range(30)]
    found = [tuple(r) for r in token_counts(documents(texts), pieces).select("doc_id", "n_bytes", "n_pretokens", "n_tokens").collect()]
    words = {w: viterbi(w, pieces) for _, t in texts for w in set(spaced(t or ""))}
    expected = [(i, len((t or "").encode()), len(spaced(t or "")), sum(words[w] for w in spaced(t or ""))) for i, t in texts]
    assert Counter(found) == Counter(expected)


def test_counts_of_real_texts(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, pieces).collect()}
    rows = docs.select("doc_id", "text").collect()
    words = {w: viterbi(w, pieces) for r in rows for w in set(spaced(r["text"]))}
    assert found == {r["doc_id"]: sum(words[w] for w in spaced(r["text"])) for r in rows}


def test_counts_of_an_empty_table(spark, documents, pieces):
    assert token_counts(documents([]), pieces).collect() == []


def encoded(df, pieces, **how):
    return [(r["doc_id"], r["text"], r["piece_ids"]) for r in encode_sampled(df, pieces, **how).collect()]


def test_decoding_gives_the_text_back(spark, documents, odd, pieces):
    df = decode_pieces(encode_sampled(documents(odd), pieces), pieces)
    assert df.columns[:13] == documents([]).columns
    rows = df.collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == Counter(odd)
    assert all((r["piece_ids"] is None) == (r["text"] is None) for r in rows)
    assert decode_pieces(encode_sampled(documents([]), pieces), pieces).collect() == []


def test_samples_depend_on_key_and_seed_alone(spark, documents, pieces):
    rows = [(i, f"thereon {i} ertionan the therewith") for i in range(60)]
    one = sorted(encoded(documents(rows).repartition(5), pieces))
    assert one == sorted(encoded(documents(rows[::-1]).coalesce(1), pieces))
    assert one != sorted(encoded(documents(rows), pieces, seed=8))
    assert encoded(documents([(1, "repeated"), (1, "repeated")]), pieces)[0] == encoded(documents([(1, "repeated")]), pieces)[0]


def all_segmentations(word, pieces):
    if not word:
        return {(): 0.0}
    found = {}
    for start, s, ids in endings(word, len(word), pieces):
        for rest, t in all_segmentations(word[:start], pieces).items():
            found[rest + ids] = t + s
    return found


@pytest.mark.parametrize("word,alpha", [(" thing", 1.0), ("門x", 1.0), (" then", 0.3)])
def test_samples_follow_the_lattice(pieces, word, alpha):
    weights = {s: math.exp(alpha * w) for s, w in all_segmentations(word, pieces).items()}
    total, n = sum(weights.values()), 20_000
    ids, sizes = sample_rows(PieceTable(pieces), alpha, np.arange(n, dtype=np.uint64) * np.uint64(7919), [word.encode()] * n)
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - k : e].tolist()) for e, k in zip(ends, sizes))
    assert set(seen) <= set(weights)
    for s, w in weights.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
