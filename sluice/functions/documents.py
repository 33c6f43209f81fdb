"""JSON values, kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import col


def encode(value: Column | str) -> Column:
    return F.to_json(col(value))


def parse(text: Column | str) -> Column:
    """JSON value in its shortest text form, or empty if it is not JSON."""
    return F.to_json(F.try_parse_json(col(text)))


decode = parse


def unpack(text: Column | str, kind: str) -> Column:
    """A typed value, or empty if the document does not have that type."""
    return F.try_variant_get(F.try_parse_json(col(text)), "$", kind)


def get(text: Column | str, name: str) -> Column:
    """A field as JSON text; a missing field is JSON null."""
    found = F.try_variant_get(F.try_parse_json(col(text)), f"$['{name}']", "variant")
    return F.coalesce(F.to_json(found), F.lit("null"))


def _json_string(text: Column) -> Column:
    """A JSON string literal, escaped by Spark's own writer."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def obj(fields: Column | str) -> Column:
    """JSON object from a list of (name, JSON text) tuples, names in list order."""
    pairs = F.transform(col(fields), lambda f: F.concat(_json_string(f["_0"]), F.lit(":"), f["_1"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def array_from_dict(entries: Column | str) -> Column:
    """Dictionary of JSON texts as an array of [key, value], in key order."""
    pairs = F.transform(
        F.sort_array(F.map_entries(col(entries))),
        lambda e: F.concat(F.lit("["), _json_string(e["key"]), F.lit(","), e["value"], F.lit("]")),
    )
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))
