"""Lists of a whole group in long form: tables of text lines and samplers, without a cell that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.lists import TableStyle
from sluice.operators.ordered import positions
from sluice.semantics import join_same


def table_lines(df: DataFrame, by: Sequence[str], order: str, columns: Mapping[str, Column], style: TableStyle) -> DataFrame:
    """A text table per group: (group, line, text), header and underline first.

    ``order`` is a unique integer within a group; an empty cell stays a cell.
    """
    by, names = list(by), list(columns)
    head = [style.header_start + style.header_separator.join(names) + style.header_end]
    if style.header_underline is not None:
        head.append(style.header_underline * len(names))
    cells = F.concat_ws(style.data_separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()])
    lines = positions(df, by, order, "__at").select(
        *by, (F.col("__at") + len(head)).alias("line"), F.concat(F.lit(style.data_start), cells, F.lit(style.data_end)).alias("text")
    )
    header = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("line"), F.lit(t).alias("text")) for i, t in enumerate(head)]))
    return lines.unionByName(df.select(*by).distinct().select(*by, header.alias("h")).select(*by, "h.*"))


@dataclass(frozen=True)
class Take:
    """The next ``n`` rows, optionally only while a condition holds."""

    n: int
    condition: Column | None = None


@dataclass(frozen=True)
class Spread:
    """``n`` rows evenly spaced over what remains; then moves on by ``n`` rows."""

    n: int


def sample_rows(df: DataFrame, by: Sequence[str], order: str, *samplers: Take | Spread) -> DataFrame:
    """Run samplers one after another over the rows of each group, in order.

    Rows are numbered, and a sampler is a condition on numbers: where it
    starts is one value per group, so no group is gathered.  A row that two
    samplers choose is given twice, as ``sampled`` 0, 1 and so on says.
    """
    by = list(by)
    rows = positions(df, by, order, "__at")
    start = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")).withColumn("__from", F.lit(0).cast("bigint"))
    chosen = []
    for number, sampler in enumerate(samplers):
        here = join_same(rows, start, by)
        place, left = F.col("__at") - F.col("__from"), F.col("__size") - F.col("__from")
        if isinstance(sampler, Take):
            hit = (place >= 0) & (place < sampler.n)
            if sampler.condition is not None:
                fails = here.filter(hit & ~F.coalesce(sampler.condition, F.lit(False))).groupBy(*by).agg(F.min("__at").alias("__stop"))
                start = join_same(start, fails, by, "left")
                here = join_same(here, fails, by, "left")
                hit = hit & (F.col("__stop").isNull() | (F.col("__at") < F.col("__stop")))
                end = F.least(F.col("__size"), F.col("__from") + sampler.n, F.coalesce("__stop", "__size"))
            else:
                end = F.least(F.col("__size"), F.col("__from") + sampler.n)
        else:
            gap = F.floor(left / sampler.n)
            hit = (place >= 0) & F.when(left <= sampler.n, F.lit(True)).otherwise((place % F.greatest(gap, F.lit(1)) == 0) & (place < gap * sampler.n))
            end = F.when(left <= sampler.n, F.col("__size")).otherwise(F.col("__from") + sampler.n)
        chosen.append(here.filter(hit).select(*df.columns, F.lit(number).alias("sampled")))
        start = start.withColumn("__from", F.greatest(end, F.col("__from"))).select(*by, "__size", "__from")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out
