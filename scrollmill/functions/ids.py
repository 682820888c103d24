"""Content-derived ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def joined(*parts) -> Column:
    """The non-empty parts, joined by the unit separator."""
    return F.concat_ws(UNIT, *[F.nullif(col(p), F.lit("")) for p in parts])


def content_hash(text) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def stable_id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined(*parts).cast("binary"), 256), 1, 24))


def conversation_id(source="source_id", signature="signature", upstream="upstream_id", title="title", started="started_at", keys="message_keys") -> Column:
    """By capture signature, else upstream id, else a hash of the content (keys: message keys in order)."""
    return (
        F.when(F.length(col(signature)) > 0, stable_id("conv", source, F.lit("captureSignature"), signature))
        .when(F.length(col(upstream)) > 0, stable_id("conv", source, F.lit("upstreamId"), upstream))
        .otherwise(stable_id("conv", source, title, started, F.array_join(col(keys), RECORD)))
    )


def message_id(conversation="conversation_id", source="source_id", upstream_or_title="conv_upstream", message="upstream_id", index="idx", created="created_at", text="text", thinking="thinking") -> Column:
    own = F.coalesce(F.nullif(col(message), F.lit("")), col(index).cast("string"))
    return stable_id("msg", conversation, source, upstream_or_title, own, created, text, thinking)


def history_key(session) -> Column:
    """The UUID inside a session id, in lower case, else the id."""
    uuid = F.lower(F.regexp_extract(col(session), r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", 1))
    return F.coalesce(F.nullif(uuid, F.lit("")), F.lower(col(session)))


def file_stem(path) -> Column:
    """A file's name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(col(path), "/"), -1), r"\."), 1)
