"""Titles, search text, tokens and snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrollmill.functions.ids import col

SPACES = r"(?U)\s+"
#: Openings of injected texts that make no title.
BOILERPLATE = (
    r"^# AGENTS\.md instructions for ",
    r"^<permissions instructions>",
    r"^<environment_context>",
    r"^<app-context>",
    r"^<developer instructions>",
    r"^<skill>",
    r"^The following is the Codex agent history",
    r"^# Files mentioned by the user:",
    r"^## Code review guidelines:",
    r"^\{\s*\"outcome\"\s*:",
    r"^\{\s*\"risk_level\"\s*:",
)
SNIPPET, LEAD = 220, 60


def trimmed(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def filled(text) -> Column:
    """Whether anything is left of a trimmed text; looks no further than its first sign."""
    return col(text).rlike(r"(?U)\S")


def collapsed(text) -> Column:
    return trimmed(F.regexp_replace(col(text), SPACES, " "))


def title_text(text) -> Column:
    """Collapsed, without a leading "Repository: ... ." sentence."""
    flat = collapsed(text)
    stop = F.instr(flat, ". ")
    return F.when(flat.rlike(r"(?i)^Repository:\s+") & (stop > 0), trimmed(F.substring(flat, stop + 2, F.length(flat)))).otherwise(flat)


def title_from_text(text, fallback) -> Column:
    flat = title_text(F.coalesce(col(text), F.lit("")))
    return F.when(flat == "", col(fallback)).when(F.length(flat) > 72, F.concat(F.substring(flat, 1, 69), F.lit("..."))).otherwise(flat)


def is_title(text) -> Column:
    flat = title_text(F.coalesce(col(text), F.lit("")))
    return (flat != "") & ~flat.rlike("(?i)" + "|".join(BOILERPLATE))


def session_title(label, session) -> Column:
    when = F.concat_ws(" ", F.nullif(F.regexp_extract(col(session), r"(\d{4}-\d{2}-\d{2})T(\d{2})[-:](\d{2})", 1), F.lit("")), F.nullif(F.concat(F.regexp_extract(col(session), r"(\d{4}-\d{2}-\d{2})T(\d{2})[-:](\d{2})", 2), F.lit(":"), F.regexp_extract(col(session), r"(\d{4}-\d{2}-\d{2})T(\d{2})[-:](\d{2})", 3)), F.lit(":")))
    short = F.when(F.length(col(session)) > 24, F.concat(F.substring(col(session), 1, 21), F.lit("..."))).otherwise(col(session))
    return F.concat(col(label), F.lit(" session "), F.when(when != "", when).otherwise(short))


def search_text(text="text", thinking="thinking") -> Column:
    return F.concat_ws("\n", F.nullif(col(text), F.lit("")), F.nullif(col(thinking), F.lit("")))


def without_files(text) -> Column:
    """File bodies of a prompt become [file]; an unterminated one takes the tail."""
    closed = F.regexp_replace(col(text), r'(?s)<file name="[^"]*">.*?</file>', "[file]")
    return F.regexp_replace(closed, r'(?s)<file name="[^"]*">.*$', "[file]")


def ascii_lower(text) -> Column:
    """A-Z lower-cased and no other letter; a text of ASCII alone takes the faster way."""
    t = col(text)
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Tokens are runs of letters and digits of folded text.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: str) -> str:
    """Case folded and without combining marks, but not NFKC: full-width letters stay."""
    if text.isascii():
        return text.lower()
    flat = unicodedata.normalize("NFD", text.lower())
    for mark in filter(unicodedata.combining, set(flat)):
        flat = flat.replace(mark, "")
    return flat


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def query_terms(query: str) -> list[str]:
    return unicodedata.normalize("NFKC", query).split()


def tokens(text) -> Column:
    return F.regexp_extract_all(folded(col(text)), F.lit(TOKEN), F.lit(0))


def make_snippet(text: str, query: str, size: int = SNIPPET) -> str:
    """The window with the most distinct terms, then the closest ones, then the earliest."""
    flat = re.sub(r"\s+", " ", text).strip()
    if len(flat) <= size:
        return flat
    terms = list(dict.fromkeys(t.lower() for t in query_terms(query)))
    low = unicodedata.normalize("NFKC", flat).lower()
    starts = {0: None}
    for term in terms:
        at = low.find(term)
        while at >= 0:
            starts[max(0, min(at - LEAD, len(low) - size))] = None
            at = low.find(term, at + len(term))

    def rank(start):
        hits = [p for p in (low[start : start + size].find(t) for t in terms) if p >= 0]
        return -len(hits), max(hits) - min(hits) if len(hits) > 1 else float("inf")

    best = min(starts, key=rank)
    return ("..." if best else "") + flat[best : best + size].strip() + ("..." if best + size < len(flat) else "")


@F.pandas_udf(StringType())
def snippet(texts: pd.Series, thinking: pd.Series, queries: pd.Series) -> pd.Series:
    """For top rows only: the snippet of the text, or of the thinking where that holds more terms."""

    def one(text, thought, query):
        text, thought = text or "", thought or ""
        held = lambda s: sum(t.lower() in unicodedata.normalize("NFKC", s).lower() for t in query_terms(query))
        if thought and held(thought) > held(text):
            return "[thinking] " + make_snippet(thought, query)
        return make_snippet(text or thought, query)

    return pd.Series([one(*row) for row in zip(texts, thinking, queries)], dtype=object)
