"""File listings and small text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.paths import normalize


def scan_unix_file(spark: SparkSession, path: str, listing: DataFrame | None = None) -> DataFrame:
    """File metadata: file, size, mtime, fetched, and what a listing table adds.

    ``listing`` supplies the columns a file system does not report (perms,
    user, group, host, atime, ctime), keyed by ``file``.  Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(
        F.regexp_replace("path", r"\A[a-z0-9]+:/*(?=/)", "").alias("file"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.current_timestamp().alias("fetched"),
    )
    return files if listing is None else files.join(listing, "file", "left")


def unix_files(listing: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """A file listing given as a table: paths normalised, times from (fractional) epoch seconds, modes from octal text.

    ``details`` adds what the listing lacks, keyed by ``file`` (of repeated
    keys the smallest row counts); columns that neither has are empty.
    """
    kinds = {"file": "string", "size": "bigint", "perms": "string", "user": "string", "group": "string", "host": "string", **{t: "double" for t in ("atime", "ctime", "mtime")}}

    def typed(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    rows = typed(listing).withColumn("file", normalize("file"))
    if details is not None:
        others = [c for c in kinds if c != "file"]
        more = typed(details).withColumn("file", normalize("file")).groupBy(F.col("file").alias("__file")).agg(F.min(F.struct(*others)).alias("__more"))
        rows = rows.join(more, F.col("file") == F.col("__file"), "left").select("file", *[F.coalesce(F.col(c), F.col(f"__more.{c}")).alias(c) for c in others])
    times = {t: F.timestamp_micros(F.round(F.col(t) * 1_000_000).cast("bigint")) for t in ("atime", "ctime", "mtime")}
    return rows.withColumns({**times, "perms": F.conv("perms", 8, 10).cast("bigint")})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def string_set_source(lines: DataFrame) -> DataFrame:
    """Distinct lines, without empty lines and lines that start with ``#``."""
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select("value").distinct()


def scan_string_set(spark: SparkSession, path: str) -> DataFrame:
    return string_set_source(_lines(spark, path))


def scan_tab_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated lines, comments dropped, as text columns; ``*`` is empty."""
    lines = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    return lines.select(*[
        F.nullif(F.get(cells, F.lit(i)), F.lit("*")).alias(c) for i, c in enumerate(columns)
    ])


def scan_expansions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a name and what it stands for: key, values."""
    lines = _lines(spark, path).select(F.trim("value").alias("value")).filter(~F.col("value").startswith("#"))
    cells = F.split("value", "\t")
    rest = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    return lines.select(F.get(cells, F.lit(0)).alias("key"), F.sort_array(F.array_distinct(rest)).alias("values"))


def scan_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Interval lines: name, start, end (empty where they are not numbers)."""
    cells = F.split("value", "\t")
    return _lines(spark, path).select(
        F.get(cells, F.lit(0)).alias("name"),
        F.get(cells, F.lit(1)).try_cast("bigint").alias("start"),
        F.get(cells, F.lit(2)).try_cast("bigint").alias("end"),
    )
