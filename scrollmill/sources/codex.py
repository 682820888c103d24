"""JSONL session logs, one session per file, with title sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.ids import file_stem, history_key
from scrollmill.operators.batch import Batch
from scrollmill.sources import base as S

ID, LABEL = "codex", "Codex"
ROLES = ("user", "assistant", "system", "tool")


def sidecar_titles(lines: DataFrame) -> DataFrame:
    """(session_key, ord, title) from history.jsonl (text) and session_index.jsonl (thread_name) lines."""
    records, _ = S.read_jsonl(lines, ID)
    session, title = V.string("v", "$.session_id", "$.sessionId", "$.id"), V.string("v", "$.thread_name", "$.display", "$.text")
    return records.select(history_key(session).alias("session_key"), F.struct("path", "line").alias("ord"), title.alias("title")).filter("session_key is not null and title is not null")


@S.register_source(ID, LABEL, "stable", r"/sessions/.*(\.jsonl|/part-[^/]*)$")
def read(spark: SparkSession, root: str, titles: DataFrame | str | None = None) -> Batch:
    """All sessions under a root; `titles` as of `sidecar_titles`, or the folder of its files."""
    S.tolerant(spark)
    if isinstance(titles, str):
        titles = sidecar_titles(S.text_lines(spark, titles))
    records, bad = S.read_jsonl(S.text_lines(spark, root, r"\.jsonl$|/part-"), ID)
    holder = F.coalesce(F.when(V.is_object(V.get("v", "$.payload.message")), V.get("v", "$.payload.message")), F.when(V.is_object(V.get("v", "$.message")), V.get("v", "$.message")), F.when(V.is_object(V.get("v", "$.payload")), V.get("v", "$.payload")))
    rows = records.withColumn("m", holder)
    named = F.coalesce(V.string("m", "$.role"), V.string("v", "$.payload.role"), V.string("v", "$.type"))
    role = F.when(named.isin(*ROLES), named).when(named.isin("function_call", "tool_result"), "tool").otherwise("unknown")
    text = F.coalesce(V.text_from_content("m", "$.content"), V.text_from_content("m", "$.text"), V.text_from_content("v", "$.payload.content"), V.text_from_content("v", "$.payload.text"))
    first = F.coalesce(V.string("v", "$.payload.session_id", "$.payload.id", "$.session_id", "$.sessionId"), file_stem("path"))
    rows = rows.select("path", "line", V.string("v", "$.type").alias("type"), role.alias("role"), text.alias("text"), first.alias("session"), F.coalesce(V.string("v", "$.id", "$.payload.id"), F.concat(F.lit("L"), F.col("line").cast("string"))).alias("upstream_id"), S.record_time().alias("created_at"), F.col("path").alias("conv_key"), F.col("line").cast("long").alias("ord"))
    rows = S.cut(rows, "events")  # messages, sessions and diagnostics are found from one parse
    good = F.col("text").isNotNull() & (F.col("role") != "unknown")
    messages = S.dedup(rows.filter(good))
    whole = rows.groupBy("conv_key").agg(F.min_by("session", "line").alias("session"))
    kept, none = S.split_empty(whole, messages, ID, "codex_no_messages", "conv_key")
    side = S.first_titles(titles) if titles is not None else spark.createDataFrame([], "session_key string, side_title string")
    done = kept.join(S.sessions(messages), "conv_key").withColumn("session_key", history_key("session")).join(side, "session_key", "left")
    conversations = done.select("conv_key", F.col("session").alias("upstream_id"), S.best_title(F.lit(""), "side_title").alias("title"), F.col("started").alias("started_at"), F.col("updated").alias("updated_at"), S.metadata(sourcePath=F.col("conv_key"), format="jsonl").alias("metadata"))
    lost = rows.filter(~good & ~((F.coalesce("type", F.lit("")) == "session_meta") & F.col("text").isNull())).join(kept.select("conv_key"), "conv_key", "left_semi")
    return S.finish(ID, LABEL, conversations, messages, [bad, none, S.unmapped(lost, ID, "codex_events_unmapped", "path")])
