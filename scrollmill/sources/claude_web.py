"""Web exports: a JSON array of conversations, one or more files."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.text import title_from_text, trimmed
from scrollmill.functions.times import EPOCH
from scrollmill.operators.batch import Batch
from scrollmill.sources import base as S

ID, LABEL = "claude-web", "Claude Web"
#: A file is an export if its start is an array that names these keys.
SNIFF = 4096


def visible(v) -> Column:
    """Text of blocks without a type or of type text; a value that is no filled array as any content."""
    item = lambda x: F.when(V.kind(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).when(V.is_object(x) & F.coalesce(V.string(x, "$.type") == "text", F.lit(True)), V.string(x, "$.text", "$.value", "$.content"))
    parts = F.filter(F.transform(V.items(v), item), lambda t: t.isNotNull())
    return F.when(F.size(V.items(v)) > 0, F.nullif(trimmed(F.array_join(parts, "\n")), F.lit(""))).otherwise(V.text_from_content(v))


@S.register_source(ID, LABEL, "experimental", r"conversations.*\.json$|/part-[^/]*$")
def read(spark: SparkSession, root: str) -> Batch:
    """All exports under a root. Array elements become rows in the JSON reader, so a file's conversations spread out."""
    S.tolerant(spark)
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    files = files.filter(F.substring("value", 1, SNIFF).rlike(r'^\s*\[') & F.substring("value", 1, SNIFF).contains('"uuid"') & F.substring("value", 1, SNIFF).contains('"chat_messages"'))
    parsed = files.withColumn("v", V.parse("value")).drop("value")
    broken = S.diagnostic(parsed.filter("v is null"), ID, "error", "source_unreadable", "The export is not valid JSON.", "path")
    rows = parsed.select("path", F.posexplode(V.items("v")).alias("n", "c")).repartition("path", "n")
    rows = rows.withColumn("upstream_id", V.string("c", "$.uuid"))
    invalid = S.diagnostic(rows.filter("upstream_id is null"), ID, "warning", "claude_web_conversation_invalid", "A conversation has no uuid.", "path")
    rows = rows.filter("upstream_id is not null").withColumn("conv_key", F.concat_ws("#", "path", F.lpad(F.col("n").cast("string"), 9, "0"))).withColumn("ref", F.concat("path", F.lit("#conversation="), "upstream_id"))
    items = rows.select("conv_key", "c", F.posexplode(V.items("c", "$.chat_messages")).alias("k", "m")).filter(V.is_object("m"))
    sender = V.string("m", "$.sender")
    role = F.when(sender.isin("human", "user"), "user").when(sender.isin("assistant", "system", "tool"), sender).otherwise("unknown")
    at = S.json_date(F.coalesce(V.get("m", "$.created_at"), V.get("m", "$.updated_at")), S.json_date(V.get("c", "$.created_at")))
    messages = items.select("conv_key", F.col("k").cast("long").alias("ord"), F.coalesce(V.string("m", "$.uuid"), F.concat(F.lit("message-"), (F.col("k") + 1).cast("string"))).alias("upstream_id"), role.alias("role"), at.alias("created_at"), F.coalesce(visible(V.get("m", "$.content")), V.string("m", "$.text")).alias("text")).filter("text is not null")
    messages = S.dedup(messages, ("upstream_id",))
    kept, none = S.split_empty(rows, messages, ID, "claude_web_no_messages", "ref")
    done = kept.join(S.sessions(messages), "conv_key")
    title = title_from_text(F.coalesce(V.string("c", "$.name"), V.string("c", "$.summary"), F.col("first_user"), F.col("first_text"), F.lit("")), F.concat(F.lit(LABEL + " "), F.col("upstream_id")))
    conversations = done.select("conv_key", "upstream_id", title.alias("title"), S.json_date(V.get("c", "$.created_at"), F.coalesce("started", F.lit(EPOCH))).alias("started_at"), S.json_date(V.get("c", "$.updated_at"), F.col("updated")).alias("updated_at"), S.metadata(sourcePath=F.col("path"), format="claude-web-export-json").alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [broken, invalid, none])
