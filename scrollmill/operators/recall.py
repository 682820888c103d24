"""Reads of the store: day digests, open by prefix, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.functions.times import local_date, local_day_range
from scrollmill.operators.windows import top_n

TODAY, DIAGNOSTICS, HINTS = 8, 50, 3


def filter_source(df: DataFrame, ids) -> DataFrame:
    """Rows of some sources; prunes partitions of a store partitioned by source_id."""
    ids = [ids] if isinstance(ids, str) else list(ids or [])
    return df.filter(F.col("source_id").isin(*ids)) if ids else df


def filter_local_day(df: DataFrame, day: str, tz: str = "UTC", columns: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Rows one of whose ISO times falls on a local calendar day; ValueError for a bad day."""
    start, end = local_day_range(day, tz)
    hit = F.lit(False)
    for c in columns:
        hit = hit | ((F.col(c) >= start) & (F.col(c) < end))
    return df.filter(hit)


def today(conversations: DataFrame, day: str, tz: str = "UTC", limit: int = TODAY) -> DataFrame:
    """Conversations that started or changed on a day, newest first."""
    return filter_local_day(conversations, day, tz, ("updated_at", "started_at")).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def today_with_coverage(store, day: str, tz: str = "UTC", limit: int = TODAY) -> tuple[DataFrame, DataFrame]:
    """The sessions of a day and, beside them, the status of all sources."""
    return today(store.conversations, day, tz, limit), sources(store.status, store.diagnostics)


def daily_digest(conversations: DataFrame, tz: str = "UTC", limit: int = TODAY) -> DataFrame:
    """The same for every day at once: (day, rank, id, ...), one shuffle by day."""
    days = F.array_distinct(F.array(local_date("started_at", tz), local_date("updated_at", tz)))
    spread = conversations.withColumn("day", F.explode(days))
    return top_n(spread, ["day"], [F.col("updated_at").desc(), F.col("id")], limit)


def day_summaries(digest: DataFrame) -> DataFrame:
    """(day, summary, hints) of a digest: a sentence, and the first ids to open."""
    rows = digest.groupBy("day").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("top"))  # at most `limit` rows a day
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " session").otherwise(" sessions"), F.lit(" touched this date."))
    return rows.select("day", text.alias("summary"), F.transform(F.slice("top", 1, HINTS), lambda r: F.concat(F.lit("open "), r["id"])).alias("hints"))


def open_conversation(conversations: DataFrame, messages: DataFrame, prefix: str) -> DataFrame:
    """The messages of the one conversation whose id starts with a prefix; ValueError if none or several do."""
    found = conversations.filter(F.col("id").startswith(prefix)).select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError("ambiguous id" if found else "not found")
    return messages.filter(F.col("conversation_id") == found[0].id).orderBy("created_at", "message_id")


def open_many(conversations: DataFrame, messages: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For a table of prefixes (prefix): status found, ambiguous or missing, and the id where found.

    Prefixes of one length are one equi-join on the cut id.
    """
    lengths = [r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]  # one row per length of a prefix
    cut = conversations.select("id", F.explode(F.array(*[F.substring("id", 1, n) for n in lengths])).alias("prefix")).distinct() if lengths else conversations.select("id", F.col("id").alias("prefix")).limit(0)
    hits = prefixes.distinct().join(cut, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    return hits.select("prefix", F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def sources(status: DataFrame, diagnostics: DataFrame, source_id=None) -> DataFrame:
    """Source status with the newest diagnostics of each (created_at desc, id), as array<struct>."""
    newest = top_n(diagnostics, ["source_id"], [F.col("created_at").desc(), F.col("id")], DIAGNOSTICS)
    lists = newest.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("rank", "severity", "code", "message"))).alias("diagnostics"))
    return filter_source(status, source_id).join(lists, "source_id", "left").orderBy("source_id")  # confidence, cursor, fingerprint and version come with the status
