"""Token counts by trie-shared dynamic programming.

A task inserts the distinct pre-tokens of a slice of its rows in a trie.  A
node gets the best unigram score of its prefix, from the scores of the nodes
above it, once for all pre-tokens that share the prefix; a pre-token's count
is stored at its last node.  The job has no shuffle, and a slice has a bounded
size, so memory does not grow with the input.

Pre-tokens are the maximal runs without ASCII white space, each with a space
put before it.  A character without a piece costs its UTF-8 bytes.  Of equal
scores the segmentation with fewer tokens counts.  Null and empty texts have
no pre-tokens and zero tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import body_sizes, keyed_text, schema_with_key, slices
from sluice.llm.lattice import TALL, PieceTable, Trie, deepened, endings, utf8_length
from sluice.llm.pieces import Pieces

SLICE = 8_000_000
_FAR = 2**40


def tall_count(word: str, pieces: Pieces) -> int:
    """Tokens of one long pre-token, character by character."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[start][0] + s, best[start][1] - len(ids)) for start, s, ids in endings(word, end, pieces)))
    return -best[-1][1]


def counts_of(words: list[str], table: PieceTable) -> np.ndarray:
    """Tokens of each distinct pre-token."""
    pieces = table.pieces
    out = np.zeros(len(words), np.int64)
    short = np.array([len(w) <= TALL for w in words], bool)
    for i in np.flatnonzero(~short).tolist():
        out[i] = tall_count(words[i], pieces)
    trie = Trie([w for w in words if len(w) <= TALL], table)
    best, tokens = np.zeros(1), np.zeros(1, np.int64)
    scores, counts = np.zeros((1, 0)), np.zeros((1, 0), np.int64)
    terminal = []
    for level in trie.levels():
        scores, counts = deepened(scores, best, level.parent, pieces.longest), deepened(counts, tokens, level.parent, pieces.longest)
        found = level.piece >= 0
        candidate = np.where(found, scores + table.score[level.piece], -np.inf)
        cost = counts + 1
        spelled = ~table.known[level.char]
        if spelled.any():
            n = utf8_length(level.char[spelled])
            candidate[spelled, 0] = scores[spelled, 0] + n * pieces.byte_score
            cost[spelled, 0] = counts[spelled, 0] + n
        best = candidate.max(axis=1)
        tokens = np.where(candidate == best[:, None], cost, _FAR).min(axis=1)
        terminal.append(tokens)
    if terminal:
        out[short] = np.concatenate(terminal)[trie.ends]
    return out


def token_counts(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_pretokens, n_tokens."""
    rows = keyed_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(pieces.plain())

    def count(batches):
        table = PieceTable(Pieces(*shared.value))
        for batch in batches:
            sizes = body_sizes(batch.column(1))
            for a, b in slices(sizes, SLICE):
                found = [body.split() if body else [] for body in batch.column(1).slice(a, b - a).to_pylist()]
                per_row = np.array([len(x) for x in found], np.int64)
                words = [w for x in found for w in x]
                del found
                distinct = list(dict.fromkeys(words))
                counts = counts_of([" " + w.decode("utf-8", "surrogateescape") for w in distinct], table)
                lookup = dict(zip(distinct, counts.tolist()))
                per_word = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
                total = np.concatenate([[0], np.cumsum(per_word)])
                ends = np.cumsum(per_row)
                tokens = total[ends] - total[ends - per_row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(per_row, pa.int64()), pa.array(tokens, pa.int64())],
                    names=[key, "n_bytes", "n_pretokens", "n_tokens"],
                )

    return rows.mapInArrow(count, schema_with_key(rows, key, "n_bytes bigint, n_pretokens bigint, n_tokens bigint"))
