"""First fit into bins by a tree of maxima.

The helper runs in the tasks, on one dictionary at a time: the leaves are the
rooms of the bins, in the order in which they were opened, and a node knows the
largest room below it, so the first bin with enough room is found, and its room
changed, in steps that grow with the logarithm of the number of bins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import travels

travels(__name__)

_NONE = -(1 << 70)


def first_fit(costs: list[int], limit: int) -> list[int]:
    """The bin of each item, in order; an item goes to the first bin with room, else to a new one.

    A bin without any room left takes nothing more, not even an item that costs nothing.
    """
    width = 1
    while width < len(costs):
        width *= 2
    most, opened, chosen = [_NONE] * (2 * width), 0, []
    for cost in costs:
        needed = cost if cost > 1 else 1
        if most[1] >= needed:
            at = 1
            while at < width:
                at *= 2
                if most[at] < needed:
                    at += 1
            room = most[at] - cost
        else:
            at, room = width + opened, limit - cost
            opened += 1
        chosen.append(at - width)
        most[at] = room
        while at > 1:
            at //= 2
            left, right = most[2 * at], most[2 * at + 1]
            best = left if left >= right else right
            if most[at] == best:
                break
            most[at] = best
    return chosen


def packed(items: Column, limit: int) -> Column:
    """Names by bin, of an array of struct<cost bigint, name string> in the order of packing; empty stays empty."""

    @F.arrow_udf("array<array<string>>")
    def bins(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            if row is None:
                out.append(None)
                continue
            found: list[list[str]] = []
            for item, at in zip(row, first_fit([i["cost"] for i in row], limit)):
                if at == len(found):
                    found.append([])
                found[at].append(item["name"])
            out.append(found)
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return bins(items)
