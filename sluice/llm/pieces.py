"""A fixed vocabulary of SentencePiece pieces as unigram log-probabilities.

The model file only lists pieces in order of preference, so probabilities
follow the Zipf-Mandelbrot rule over that order; nothing is trained.  The
vocabulary has a fixed size, which is why it can be broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

#: Where the box keeps the model; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The shift of the Zipf-Mandelbrot rule.
SHIFT = 2.7


@dataclass(frozen=True)
class Pieces:
    """score: piece text (with plain spaces) to log-probability; ids: piece text to id;
    byte_ids: id of each byte; surface: id to bytes; byte_score: log-probability of a byte."""

    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    surface: list[bytes]
    byte_score: float
    longest: int

    def plain(self) -> tuple:
        """The fields as built-in values, for a broadcast; ``Pieces(*plain)`` gives them back."""
        return tuple(getattr(self, f.name) for f in fields(self))


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model with byte pieces on the driver.

    Pieces must keep to word borders (a space only before the word, no line
    feed), because texts are cut there; other models are refused.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    score, ids, byte_ids, surface = {}, {}, [-1] * 256, [b""] * sp.get_piece_size()
    rank, total = 0, 0.0
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            byte_ids[value], surface[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i).replace(SPACE, " ")
            if "\n" in piece or " " in piece.lstrip(" "):
                raise ValueError(f"piece {piece!r} crosses a word border")
            ids[piece], surface[i] = i, piece.encode()
            score[piece] = -math.log(rank + SHIFT)
            total += 1 / (rank + SHIFT)
            rank += 1
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    lowest = 1 / (rank + SHIFT)
    norm = math.log(total + 256 * lowest)
    return Pieces({p: s - norm for p, s in score.items()}, ids, byte_ids, surface, math.log(lowest) - norm, max(map(len, score)))
