"""Tolerant reads of JSON values as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmill.functions.ids import col
from scrollmill.functions.text import filled, trimmed


def parse(text) -> Column:
    return F.try_parse_json(col(text))


def get(v, path: str) -> Column:
    return F.try_variant_get(col(v), path, "variant")


def kind(v) -> Column:
    """STRING, ARRAY..., OBJECT..., another scalar's type, or null."""
    return F.schema_of_variant(col(v))


def is_object(v) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def string(v, *paths: str) -> Column:
    """The first of some paths that holds a non-blank JSON string."""
    found = []
    for path in paths or ("$",):
        text = F.try_variant_get(col(v), path, "string")
        found.append(F.when((kind(get(v, path)) == "STRING") & filled(text), text))
    return F.coalesce(*found)


def number(v, path: str = "$") -> Column:
    """A JSON number, as double."""
    return F.when(~F.coalesce(kind(get(v, path)).rlike("^(STRING|BOOLEAN|VOID|ARRAY|OBJECT)"), F.lit(True)), F.try_variant_get(col(v), path, "double"))


def items(v, path: str = "$") -> Column:
    """A JSON array as array<variant>, else an empty one."""
    return F.coalesce(F.try_variant_get(col(v), path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def strings(v, path: str = "$") -> Column:
    """The texts of a JSON array, trimmed, blank ones left out; nothing of any other value."""
    own = F.filter(items(v, path), lambda x: F.coalesce(kind(x) == "STRING", F.lit(False)))
    return F.filter(F.transform(own, lambda x: trimmed(F.try_variant_get(x, "$", "string"))), lambda t: t != "")


def text_of(v) -> Column:
    """A string, or the text, value or content of an object."""
    return F.when(kind(v) == "STRING", F.nullif(trimmed(F.try_variant_get(col(v), "$", "string")), F.lit(""))).otherwise(string(v, "$.text", "$.value", "$.content"))


def text_from_content(v, path: str = "$") -> Column:
    """Text of a string, an object, or an array of both (joined by newlines); null where empty."""
    v = get(v, path)
    whole = lambda x: F.when(kind(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).otherwise(string(x, "$.text", "$.value", "$.content"))
    parts = F.filter(F.transform(items(v), whole), lambda t: t.isNotNull())
    many = F.nullif(trimmed(F.array_join(parts, "\n")), F.lit(""))
    return F.when(kind(v).startswith("ARRAY"), many).otherwise(text_of(v))
