"""A trie of distinct strings, built level by level, with the pieces that end at each node.

``Trie`` inserts many strings at once: level d holds one node per distinct
prefix of d characters, so whatever is computed per node is computed once per
shared prefix.  A node knows, for every length up to the longest piece, the
hash of its last characters (from its parent's hashes) and hence the pieces
that end there.  Strings beyond ``TALL`` characters would need as many levels;
they are walked one by one with ``endings``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from sluice.llm.pieces import Pieces

TALL = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 1 << 20


class PieceTable:
    """The pieces by a 64-bit hash of their characters."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        words = list(pieces.ids)
        hashes = np.zeros(len(words), np.uint64)
        for i, word in enumerate(words):
            h = 0
            for c in word:
                h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
            hashes[i] = h
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.ids = np.array([pieces.ids[w] for w in words], np.int32)[order]
        self.score = np.array([pieces.score[w] for w in words])[order]
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.hashes >> np.uint64(44)] = True
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(w) for w in words if len(w) == 1]] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the table, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        likely = self.filter[hashes >> np.uint64(44)]
        asked = hashes[likely]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        out[likely] = np.where(self.hashes[at] == asked, at, -1)
        return out


@dataclass
class Level:
    """Nodes with prefixes of one length: ``parent`` numbers the level above,
    ``char`` is the last character, ``piece[:, l]`` the table row of the piece of l+1 characters that ends here."""

    parent: np.ndarray
    char: np.ndarray
    piece: np.ndarray
    first: int


def utf8_length(chars: np.ndarray) -> np.ndarray:
    """Bytes of each code point; 1 for the escapes of bytes that are not UTF-8."""
    n = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    return np.where((chars >= 0xDC80) & (chars <= 0xDCFF), 1, n).astype(np.int64)


class Trie:
    """``ends[i]`` is the node of string i; ``levels()`` yields the levels from the top.

    Nodes are numbered level by level from 0; the root has no number (-1).
    Strings must have from 1 to ``TALL`` characters.
    """

    def __init__(self, strings: list[str], table: PieceTable):
        self.table = table
        lengths = np.array([len(s) for s in strings], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.ends = np.full(len(strings), -1, np.int64)
        self.nodes = 0

    def levels(self) -> Iterator[Level]:
        longest = self.table.pieces.longest
        node = np.zeros(len(self.lengths), np.int64)  # of each string in the level above
        hashes = np.zeros((1, 0), np.uint64)
        for depth in range(int(self.lengths[0]) if len(self.lengths) else 0):
            alive = int(np.searchsorted(-self.lengths, -depth, side="left"))
            keys, node = np.unique(node[:alive] << 21 | self.codes[self.starts[:alive] + depth], return_inverse=True)
            parent, char = keys >> 21, keys & 0x1FFFFF
            above = hashes[parent, : longest - 1]
            hashes = np.empty((len(keys), above.shape[1] + 1), np.uint64)
            hashes[:, 0] = char + 1
            hashes[:, 1:] = above * _BASE
            hashes[:, 1:] += hashes[:, :1]
            yield Level(parent, char, self.table.find(hashes), self.nodes)
            done = self.lengths[:alive] == depth + 1
            self.ends[self.order[:alive][done]] = self.nodes + node[done]
            self.nodes += len(keys)


def deepened(above: np.ndarray, own: np.ndarray, parent: np.ndarray, longest: int) -> np.ndarray:
    """Values of the last ``longest`` nodes above each node: its parent's own value, then the parent's ancestors'."""
    kept = above[parent, : longest - 1]
    out = np.empty((len(parent), kept.shape[1] + 1), own.dtype)
    out[:, 0] = own[parent]
    out[:, 1:] = kept
    return out


def endings(word: str, end: int, pieces: Pieces) -> list[tuple[int, float, tuple[int, ...]]]:
    """(start, log-probability, ids) of what can end a prefix of ``end`` characters, shortest first."""
    found = []
    for start in range(end - 1, max(0, end - pieces.longest) - 1, -1):
        piece = word[start:end]
        if piece in pieces.score:
            found.append((start, pieces.score[piece], (pieces.ids[piece],)))
        elif start == end - 1:
            raw = piece.encode("utf-8", "surrogateescape")
            found.append((start, len(raw) * pieces.byte_score, tuple(pieces.byte_ids[b] for b in raw)))
    return found
