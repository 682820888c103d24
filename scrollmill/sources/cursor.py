"""Agent transcripts: one file per transcript id, several copies possible, times from the file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.text import filled, is_title, session_title, title_from_text, trimmed
from scrollmill.functions.times import iso
from scrollmill.operators.batch import Batch
from scrollmill.operators.windows import keep_first
from scrollmill.sources import base as S

ID, LABEL = "cursor", "Cursor"
#: The transcript's id is its folder's name (a partition folder's value).
FOLDER = r"/(?:[A-Za-z_]+=)?([^/]+)/[^/]+$"
COUNTERS = {
    "duplicates": ("info", "cursor_duplicates_deduplicated", "copies of a transcript were left out."),
    "invalid": ("error", "cursor_transcript_invalid", "transcripts were skipped because a record is broken."),
    "no_messages": ("info", "cursor_no_messages", "transcripts had no importable messages."),
    "incomplete": ("info", "cursor_trailing_incomplete", "transcripts end in a record that is not complete yet."),
    "unknown": ("warning", "cursor_schema_unknown", "transcripts have block types that are not known."),
}


def candidates(spark: SparkSession, root: str):
    """(files, messages): one row per file with its counts and flags, and the messages of all files, from lines that are read and parsed once."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
    raw = raw.filter(F.col("path").rlike("agent-transcripts/") & ~F.col("path").rlike("/subagents?/")).withColumn("seq", F.monotonically_increasing_id())
    by_file = S.Window.partitionBy("path")
    lines = raw.withColumn("line", F.row_number().over(by_file.orderBy("block", "seq"))).withColumn("bytes", F.sum(F.octet_length("value") + 1).over(by_file))
    lines = lines.filter(filled("value")).withColumn("v", V.parse("value")).withColumn("last", F.max("line").over(by_file))
    bad_json = F.col("v").isNull()
    said = V.is_object("v") & F.coalesce(F.try_variant_get("v", "$.role", "string").isin("user", "assistant") & (V.kind(V.get("v", "$.role")) == "STRING"), F.lit(False))
    blocks = V.items("v", "$.message.content")
    shape = V.is_object(V.get("v", "$.message")) & F.coalesce(V.kind(V.get("v", "$.message.content")).startswith("ARRAY"), F.lit(False))
    kind = lambda b: F.when(V.kind(V.get(b, "$.type")) == "STRING", F.try_variant_get(b, "$.type", "string"))
    fine = shape & F.forall(blocks, lambda b: V.is_object(b) & ((F.coalesce(kind(b), F.lit("")) != "text") | F.coalesce(V.kind(V.get(b, "$.text")) == "STRING", F.lit(False))))
    texts = F.filter(F.transform(F.filter(blocks, lambda b: F.coalesce(kind(b) == "text", F.lit(False))), lambda b: trimmed(F.try_variant_get(b, "$.text", "string"))), lambda t: t != "")
    odd = F.exists(blocks, lambda b: F.coalesce(~kind(b).isin("text", "tool_use"), F.lit(False)))
    rows = lines.select("path", "line", "modified", "size", "bytes", "last", bad_json.alias("bad"), said.alias("said"), (said & ~fine).alias("broken"), (said & odd).alias("odd"), F.when(said, F.nullif(trimmed(F.array_join(texts, "\n")), F.lit(""))).alias("text"), F.when(said, F.try_variant_get("v", "$.role", "string")).alias("role"))
    rows = S.cut(rows, "lines")
    cut = F.col("bad") & (F.col("line") == F.col("last")) & (F.col("bytes") > F.col("size"))
    files = rows.groupBy("path").agg(F.max("modified").alias("modified"), F.bool_or(F.col("broken") | (F.col("bad") & ~cut)).alias("invalid"), F.bool_or(cut).alias("incomplete"), F.bool_or("odd").alias("unknown"), F.count("text").alias("complete"))
    return files.withColumn("id", F.regexp_extract("path", FOLDER, 1)), rows.filter("text is not null")


def best_transcript(files):
    """Of the valid files of each transcript id, that with the most messages, then the newest."""
    return keep_first(files.filter("not invalid and complete > 0"), ["id"], [F.col("complete").desc(), F.col("modified").desc(), F.col("path")])


@S.register_source(ID, LABEL, "experimental", r"/agent-transcripts/[^/]+/[^/]+(\.jsonl|\.txt)$", by_file=False)
def read(spark: SparkSession, root: str) -> Batch:
    S.tolerant(spark)
    files, rows = candidates(spark, root)
    files = S.cut(files, "files")
    best = best_transcript(files)
    counts = files.groupBy().agg(
        (F.count("*") - F.count_distinct("id")).alias("duplicates"),
        F.count_if("invalid").alias("invalid"),
        F.count_if((F.col("complete") == 0) & ~F.col("invalid")).alias("no_messages"),
        F.count_if("incomplete").alias("incomplete"),
        F.count_if("unknown").alias("unknown"),
    )
    told = counts.select(F.explode(F.array(*[F.struct(F.col(c).alias("n"), F.lit(s).alias("severity"), F.lit(code).alias("code"), F.concat(F.col(c).cast("string"), F.lit(" " + text)).alias("message")) for c, (s, code, text) in COUNTERS.items()])).alias("d")).select("d.*").filter("n > 0")
    told = told.select(F.lit(ID).alias("source_id"), "severity", "code", "message", F.lit(root).alias("evidence_ref"))
    at = iso("modified")
    messages = rows.join(best.select("path", F.col("id").alias("conv_key")), "path").select("conv_key", F.col("line").cast("long").alias("ord"), F.concat(F.lit("line:"), F.col("line").cast("string")).alias("upstream_id"), "role", at.alias("created_at"), "text")
    done = best.withColumn("conv_key", F.col("id")).join(S.sessions(messages), "conv_key")
    title = title_from_text(F.when(is_title("first_user"), F.col("first_user")).otherwise(""), session_title(F.lit(LABEL), "id"))
    conversations = done.select("conv_key", F.col("id").alias("upstream_id"), title.alias("title"), at.alias("started_at"), at.alias("updated_at"), S.metadata(sourcePath=F.col("path"), surface="desktop-cli", timestampSource="file-mtime").alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [told])
