"""A Bloom filter of fixed size, to leave rows out before a join that settles the matter.

It has 2**24 bits whatever is put in: with very many keys it lets everything
through, which costs time and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 24


def bloom_filter(keys: DataFrame) -> Broadcast:
    """Broadcast bits of the ``xxhash64`` of the frame's columns, two per row (2 MB, made of 2**18 words at most)."""
    h = F.xxhash64(*keys.columns)
    places = F.array(F.shiftrightunsigned(h, 64 - _BITS), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(2**_BITS - 1)))
    bits = keys.select(F.explode(places).alias("bit"))
    mask = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    words = bits.select(F.shiftright("bit", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    flags = np.zeros(2 ** (_BITS - 6), np.int64)
    flags[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(flags.tobytes())


def bloom_flags(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)


def let_through(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each row may be in the filter, from the ``xxhash64`` of its key."""
    h = hashes.view(np.uint64)
    return flags[h >> np.uint64(64 - _BITS)] & flags[(h >> np.uint64(16)) & np.uint64(2**_BITS - 1)]


def may_be_in(shared: Broadcast, *columns: Column) -> Column:
    """Whether the columns of a row may be in the filter; only their hash goes to the task's Python."""

    @F.pandas_udf("boolean")
    def let(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = bloom_flags(shared.value)
        for h in hashes:
            yield pd.Series(let_through(flags, h.to_numpy(np.int64)))

    return let(F.xxhash64(*columns))
