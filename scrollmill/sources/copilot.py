"""Chat sessions of request and response pairs: one JSON object, or JSONL snapshots of which the fullest counts."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.ids import file_stem
from scrollmill.functions.text import title_from_text, trimmed
from scrollmill.operators.batch import Batch
from scrollmill.operators.windows import keep_first
from scrollmill.sources import base as S

ID, LABEL = "copilot", "GitHub Copilot"


def response_text(r) -> Column:
    chunks = F.filter(F.transform(V.items(r, "$.response"), lambda x: F.coalesce(V.text_of(V.get(x, "$.value")), V.text_of(V.get(x, "$.text")), V.text_of(V.get(x, "$.content")))), lambda t: t.isNotNull())
    direct = [V.text_from_content(r, p) for p in ("$.response", "$.result", "$.result.message", "$.result.response")]
    return F.coalesce(*direct, F.nullif(trimmed(F.array_join(chunks, "\n")), F.lit("")))


@S.register_source(ID, LABEL, "experimental", r"/chatSessions/.*(\.jsonl?|/part-[^/]*)$")
def read(spark: SparkSession, root: str) -> Batch:
    S.tolerant(spark)
    lines = S.text_lines(spark, root, r"\.jsonl?$|/part-")
    records, bad = S.read_jsonl(lines, ID)
    session = F.coalesce(F.when(V.is_object(V.get("v", "$.v")), V.get("v", "$.v")), F.col("v"))
    snapshots = records.select("path", "line", session.alias("s")).withColumn("n", F.size(V.items("s", "$.requests")))
    snapshots = snapshots.filter((F.col("n") > 0) | V.string("s", "$.sessionId").isNotNull())
    best = keep_first(snapshots, ["path"], [F.col("n").desc(), F.col("line")]).withColumn("conv_key", F.col("path"))
    fallback = S.json_date(V.get("s", "$.creationDate"))
    asked = best.select("conv_key", "s", F.posexplode(V.items("s", "$.requests")).alias("k", "r")).filter(V.is_object("r"))
    rid = F.coalesce(V.string("r", "$.requestId", "$.id"), F.concat(F.lit("request-"), (F.col("k") + 1).cast("string")))
    at = S.json_date(F.coalesce(V.get("r", "$.timestamp"), V.get("r", "$.creationDate"), V.get("s", "$.creationDate")), fallback)
    until = S.json_date(F.coalesce(V.get("r", "$.responseDate"), V.get("r", "$.lastMessageDate"), V.get("s", "$.lastMessageDate")), at)
    user = F.coalesce(*[V.text_from_content("r", p) for p in ("$.message", "$.message.text", "$.prompt", "$.text")])
    pair = F.array(
        F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), at.alias("created_at"), user.alias("text")),
        F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), until.alias("created_at"), response_text("r").alias("text")),
    )
    sides = asked.select("conv_key", "k", rid.alias("rid"), F.inline(pair))
    missing = S.diagnostic(sides.filter("side = 1 and text is null"), ID, "warning", "copilot_response_unmapped", "A response's shape was not recognized.", "conv_key")
    every = sides.filter("text is not null").select("conv_key", (F.col("k") * 2 + F.col("side")).cast("long").alias("ord"), F.concat("rid", F.lit(":"), "role").alias("upstream_id"), "role", "created_at", "text")
    messages = S.dedup(every)
    kept, none = S.split_empty(best, messages, ID, "copilot_no_messages", "conv_key")
    idle = S.diagnostic(best.filter("n = 0"), ID, "warning", "copilot_no_requests", "The session has no requests.", "conv_key")
    done = kept.join(S.sessions(every), "conv_key").withColumn("upstream_id", F.coalesce(V.string("s", "$.sessionId", "$.id"), file_stem("path")))
    title = title_from_text(F.coalesce(V.string("s", "$.customTitle", "$.name", "$.title"), F.col("first_user"), F.lit("")), F.concat(F.lit("Copilot "), F.col("upstream_id")))
    updated = S.json_date(F.coalesce(V.get("s", "$.lastMessageDate"), V.get("s", "$.updatedAt")), F.col("last_time"))
    conversations = done.select("conv_key", "upstream_id", title.alias("title"), F.col("first_time").alias("started_at"), updated.alias("updated_at"), S.metadata(sourcePath=F.col("path"), workspace=V.string("s", "$.workspaceFolder", "$.workspace")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [bad, missing, none, idle])
