"""Write rows in an exchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Writer options of each text dialect.
DIALECTS: dict[str, dict[str, str]] = {
    "CSV_EXCEL": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'},
    "CSV_MONGO": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'},
    "CSV_MYSQL": {"sep": "\t", "quote": "\0", "escape": "\\", "lineSep": "\n", "nullValue": "\\N", "emptyValue": ""},
    "CSV_POSTGRESQL": {
        "sep": ",", "quote": '"', "escape": '"', "lineSep": "\n", "nullValue": "", "quoteAll": "true",
        "emptyValue": '""',
    },
    "CSV_RFC4180": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'},
    "TSV": {"sep": "\t", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'},
    "TSV_MONGO": {"sep": "\t", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'},
}
FORMATS = (*DIALECTS, "JSON", "JSON_SECS", "JSON_MILLIS", "XML", "XML_SECS", "XML_MILLIS")

_SCALARS = (T.NumericType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.VariantType)


def extract_type_check(df: DataFrame, fmt: str) -> None:
    """Raise before any work if a column cannot be written in this format."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown output format {fmt}; one of {', '.join(FORMATS)}")
    if fmt in DIALECTS:
        for f in df.schema:
            if not isinstance(f.dataType, _SCALARS):
                raise TypeError(f"column {f.name} of type {f.dataType.simpleString()} is not supported by {fmt}")


def _time(ts: Column, form: str) -> Column:
    if form == "SECS":
        return (F.unix_micros(ts) / F.lit(1_000_000.0)).cast("double")
    if form == "MILLIS":
        return F.unix_millis(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    thousandths = F.when(micros % 1000 == 0, F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")).otherwise(
        F.lpad(micros.cast("string"), 6, "0")
    )
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), thousandths)), F.lit("Z"))


def encoded_times(df: DataFrame, form: str = "") -> DataFrame:
    """Dates as ISO text, seconds (``SECS``) or milliseconds (``MILLIS``)."""
    return df.select(*[
        _time(F.col(f.name).cast("timestamp"), form).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema
    ])


def extract(df: DataFrame, path: str, fmt: str) -> None:
    """Write the rows as files of one format under ``path``.

    JSON has one object per line, so that files can be written in parallel.
    """
    extract_type_check(df, fmt)
    kind, _, form = fmt.partition("_")
    if fmt in DIALECTS:
        out = encoded_times(df).write.options(**DIALECTS[fmt]).option("header", True)
        out.mode("overwrite").csv(path)
    elif kind == "JSON":
        encoded_times(df, form).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        out = encoded_times(df, form).write.format("xml").option("rootTag", "records").option("rowTag", "record")
        out.mode("overwrite").save(path)
