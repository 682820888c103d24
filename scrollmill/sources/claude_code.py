"""JSONL project logs: several sessions may share a file, and a session may span files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.ids import file_stem
from scrollmill.functions.text import session_title
from scrollmill.operators.batch import Batch, exists
from scrollmill.sources import base as S

ID, LABEL = "claude-code", "Claude Code"
ROLES = ("user", "assistant", "system", "tool")


def history_titles(lines: DataFrame) -> DataFrame:
    """(session_key, ord, title) from the lines of a log of prompts."""
    records, _ = S.read_jsonl(lines, ID)
    rows = records.select(V.string("v", "$.sessionId", "$.session_id").alias("session_key"), F.struct("path", "line").alias("ord"), V.string("v", "$.display").alias("title"))
    return rows.filter("session_key is not null and title is not null")


@S.register_source(ID, LABEL, "stable", r"\.jsonl$|/part-[^/]*$")
def read(spark: SparkSession, root: str, history: DataFrame | str | None = None) -> Batch:
    """All sessions under a root; `history` is an optional sidecar: its path, or (session_key, ord, title).

    Without one, the log of prompts above a root in a `.claude` folder is read, if there is one.
    """
    S.tolerant(spark)
    if history is None and isinstance(root, str) and "/.claude/" in root:
        beside = root[: root.rindex("/.claude/") + 9] + "history.jsonl"
        history = beside if exists(spark, beside) else None
    if isinstance(history, str):
        history = history_titles(S.text_lines(spark, history))
    records, bad = S.read_jsonl(S.text_lines(spark, root, r"\.jsonl$|/part-"), ID)
    session = F.coalesce(V.string("v", "$.sessionId", "$.session_id"), file_stem("path"))
    named = F.coalesce(V.string("v", "$.message.role"), V.string("v", "$.type"))
    role = F.when((V.string("v", "$.type") == "queue-operation") & (V.string("v", "$.operation") == "enqueue"), "user").when(named.isin(*ROLES), named).when(named == "tool_result", "tool").otherwise("unknown")
    text = F.coalesce(*[V.text_from_content("v", p) for p in ("$.message.content", "$.content", "$.text", "$.summary")])
    rows = records.select("path", "line", session.alias("conv_key"), role.alias("role"), text.alias("text"), F.coalesce(V.string("v", "$.uuid", "$.id"), F.concat(F.lit("L"), F.col("line").cast("string"))).alias("upstream_id"), S.record_time().alias("created_at"))
    rows = S.cut(rows, "events")  # messages, sessions and diagnostics are found from one parse
    rows = rows.withColumn("ord", F.dense_rank().over(S.Window.partitionBy("conv_key").orderBy("path", "line")).cast("long"))
    messages = S.dedup(rows.filter("text is not null"))
    whole = rows.groupBy("conv_key").agg(F.min("path").alias("path"))
    kept, none = S.split_empty(whole, messages, ID, "claude_code_no_messages", "path")
    titles = S.first_titles(history) if history is not None else spark.createDataFrame([], "session_key string, side_title string")
    done = kept.join(S.sessions(messages), "conv_key").join(titles.withColumnRenamed("session_key", "conv_key"), "conv_key", "left")
    conversations = done.select("conv_key", F.col("conv_key").alias("upstream_id"), S.best_title(session_title(F.lit(LABEL), "conv_key"), "side_title").alias("title"), F.col("started").alias("started_at"), F.col("updated").alias("updated_at"), S.metadata(sourcePath=F.col("path"), format="jsonl", project=file_stem("path")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [bad, none, S.unmapped(rows.filter("text is null"), ID, "claude_code_events_unmapped", "path")])
