"""Source health, totals, and summaries of diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.operators.batch import DIAGNOSTICS, STORE, Batch, Store, shaped

#: Codes that are summarized per source and severity.
SUMMARY_CODES = (
    "claude_code_events_unmapped",
    "claude_code_no_messages",
    "claude_web_no_messages",
    "codex_events_unmapped",
    "codex_no_messages",
    "copilot_no_messages",
    "copilot_no_requests",
    "copilot_response_unmapped",
    "cursor_no_messages",
    "grok_build_no_messages",
    "kimi_code_no_messages",
    "opencode_no_messages",
    "pi_no_messages",
)


def summarize_diagnostics(rows: DataFrame) -> DataFrame:
    """Groups of known codes become one row each: how many, and how many events their leading numbers add up to."""
    known = F.col("code").isin(*SUMMARY_CODES)
    lead = F.coalesce(F.nullif(F.regexp_extract("message", r"^(\d+)\b", 1), F.lit("")).cast("long"), F.lit(0))
    grouped = rows.filter(known).groupBy("source_id", "severity", "code").agg(
        F.count("*").alias("n"), F.sum(lead).alias("skipped"), F.min("message").alias("only"), F.min("evidence_ref").alias("evidence_ref"),
    )
    text = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("code"), F.lit(" diagnostics were summarized."), F.when(F.col("skipped") > 0, F.concat(F.lit(" "), F.col("skipped").cast("string"), F.lit(" source events or conversations were skipped."))).otherwise(""))
    summed = grouped.withColumn("message", F.when(F.col("n") == 1, F.col("only")).otherwise(text))
    return shaped(rows.filter(~known), DIAGNOSTICS).unionByName(shaped(summed, DIAGNOSTICS))


def source_totals(conversations: DataFrame, messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, conversations, messages, evidence)."""
    a = conversations.groupBy("source_id").agg(F.count("*").alias("conversations"))
    b = messages.groupBy("source_id").agg(F.count("*").alias("messages"))
    c = evidence.groupBy("source_id").agg(F.count("*").alias("evidence"))
    out = a.join(b, "source_id", "full").join(c, "source_id", "full")
    return out.select("source_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("conversations", "messages", "evidence")])


def import_totals(messages: DataFrame) -> DataFrame:
    """(source_id, conversations, messages) with the grand total under a null source."""
    return messages.rollup("source_id").agg(F.count_distinct("conv_key").alias("conversations"), F.count("*").alias("messages"))


def roll_up_health(errors: DataFrame, previous: DataFrame, scope: str) -> DataFrame:
    """(source_id, health) from (source_id, failed) and the previous (source_id, health): an error makes a source partial;
    else a partial import keeps the previous health, and a full one is healthy."""
    old = previous.select("source_id", F.col("health").alias("before"))
    rows = errors.groupBy("source_id").agg(F.bool_or("failed").alias("failed")).join(old, "source_id", "left")
    calm = F.coalesce(F.col("before"), F.lit("healthy")) if scope == "partial" else F.lit("healthy")
    return rows.select("source_id", F.when(F.col("failed"), "partial").otherwise(calm).alias("health"))


def mark_absent(status: DataFrame, source_id: str, label: str | None = None, confidence: str | None = None, reason: str | None = None) -> DataFrame:
    """A source without files: absent; its counts and last import stay, one never seen before gets a row of zeros."""
    spark = status.sparkSession
    row = spark.createDataFrame([(source_id, label or source_id, "absent", confidence, reason)], "source_id string, label string, health string, confidence string, confidence_reason string")
    old = status.filter(F.col("source_id") == source_id).select("source_id", "last_import_at", "conversations", "messages", "evidence", "cursor", "schema_fingerprint", "source_version")
    fresh = row.join(old, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS})
    return status.filter(F.col("source_id") != source_id).unionByName(shaped(fresh, STORE["status"]))


COUNTS = ("conversations", "messages", "evidence")


def roll_up_status(previous: DataFrame, store: Store, batch: Batch, change, scope: str, at: str) -> DataFrame:
    """Status after a change: health, and totals from the former ones less what the change takes away plus what it adds.

    Only sources without a former row are counted in the store.
    """
    errors = batch.conversations.select("source_id", F.lit(False).alias("failed")).union(batch.facts.select("source_id", F.lit(False))).union(batch.diagnostics.filter("source_id is not null").select("source_id", F.col("severity") == "error"))
    health = roll_up_health(errors, previous, scope)
    labels = batch.conversations.groupBy("source_id").agg(F.min("source_label").alias("named"))
    facts = batch.facts.groupBy("source_id").agg(*[F.min(c).alias(c) for c in ("label", "confidence", "confidence_reason", "cursor", "schema_fingerprint", "source_version")])
    unknown = health.select("source_id").join(previous, "source_id", "left_anti")
    counted = lambda rows, sign: rows.groupBy("source_id").agg((sign * F.count("*")).alias("conversations"), (sign * F.sum("message_count")).alias("messages")).withColumn("evidence", F.lit(0).cast("long"))
    proofs = lambda rows: rows.groupBy("source_id").agg(F.count("*").alias("evidence")).select("source_id", F.lit(0).cast("long").alias("conversations"), F.lit(0).cast("long").alias("messages"), "evidence")
    old = previous.select("source_id", *COUNTS).join(change.cleared.withColumn("clear", F.lit(True)), "source_id", "left")
    old = old.select("source_id", "conversations", "messages", F.when(F.col("clear"), F.lit(0)).otherwise(F.col("evidence")).alias("evidence"))
    touched = change.conversations.select("id").union(change.gone).distinct()
    parts = [counted(store.conversations.join(unknown, "source_id", "left_semi"), 1), proofs(store.evidence.join(unknown, "source_id", "left_semi").join(change.cleared, "source_id", "left_anti"))]
    parts += [counted(store.conversations.join(touched, "id", "left_semi"), -1), counted(change.conversations, 1), proofs(change.evidence)]
    for part in parts:
        old = old.unionByName(part)
    totals = old.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    known = previous.select("source_id", F.col("label").alias("l"), F.col("confidence").alias("c"), F.col("confidence_reason").alias("r"))
    fresh = health.join(labels, "source_id", "left").join(facts, "source_id", "left").join(totals, "source_id", "left").join(known, "source_id", "left").withColumn("last_import_at", F.lit(at))
    fresh = fresh.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS}).withColumns({"label": F.coalesce("named", "label", "l", "source_id"), "confidence": F.coalesce("confidence", "c"), "confidence_reason": F.coalesce("confidence_reason", "r")})
    return previous.join(fresh.select("source_id"), "source_id", "left_anti").unionByName(shaped(fresh, STORE["status"]))
