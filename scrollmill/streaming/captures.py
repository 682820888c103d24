"""Capture payloads: validation, batches, and the stream that merges them into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import urls
from scrollmill.functions.text import trimmed
from scrollmill.functions.times import iso
from scrollmill.operators import export, merge
from scrollmill.operators.batch import MESSAGES, Batch, Store, shaped, temporary

LINKED = "array<struct<name:string,title:string,url:string>>"
PAYLOAD = (
    "schemaVersion int, sourceId string, sourceLabel string, site string, upstreamConversationId string, url string, title string, capturedAt string, startedAt string, updatedAt string, captureSignature string, "
    f"messages array<struct<upstreamId:string,upstreamIds:array<string>,role:string,createdAt:string,updatedAt:string,text:string,thinking:string,modelId:string,attachments:{LINKED},citations:{LINKED},media:array<struct<type:string,title:string,url:string,thumbnail:string,width:double>>>>, "
    "diagnostics array<struct<severity:string,code:string,message:string>>"
)
ROLES = ("user", "assistant", "system", "tool", "unknown")
ID_RULE, LONGEST_ID = r"^[A-Za-z0-9_-]{1,96}$", 256


def parse_captures(rows: DataFrame) -> DataFrame:
    """(value) to (value, p, valid): version 1, known roles, ISO times, ids of the allowed form."""
    p = F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE"})
    good = lambda t: t.isNotNull() & F.try_to_timestamp(t).isNotNull()
    parsed = rows.select("value", p.alias("p"))
    c = F.col("p")
    valid = (
        (c["schemaVersion"] == 1)
        & c["site"].rlike(ID_RULE)
        & (F.length(c["sourceId"]) > 0)
        & (F.length(c["captureSignature"]) > 0)
        & good(c["capturedAt"])
        & good(c["startedAt"])
        & good(c["updatedAt"])
        & c["messages"].isNotNull()
        & F.forall(c["messages"], lambda m: m["role"].isin(*ROLES) & m["text"].isNotNull() & good(m["createdAt"]))
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def quarantined(captures: DataFrame) -> DataFrame:
    return captures.filter("not valid").select("value")


def clean_ids(ids):
    """Trimmed, without repeats, blanks and overlong ids."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.expr("cast(array() as array<string>)")), trimmed), lambda x: (x != "") & (F.length(x) <= LONGEST_ID)))


def captures_to_batch(captures: DataFrame) -> Batch:
    """Valid captures as a partial batch: URLs cleaned, images rewritten, unsafe metadata dropped; keyed by arrival order."""
    good = captures.filter("valid").select("p.*")
    key = F.concat_ws("\x1f", iso(F.col("capturedAt").cast("timestamp")), "captureSignature")
    rows = good.withColumn("conv_key", F.concat_ws("\x1f", "sourceId", key))
    time = lambda c: iso(F.try_to_timestamp(c))
    conversations = rows.select("conv_key", F.col("sourceId").alias("source_id"), F.col("sourceLabel").alias("source_label"), F.col("upstreamConversationId").alias("upstream_id"), F.coalesce(F.nullif(trimmed("title"), F.lit("")), F.col("upstreamConversationId"), F.col("captureSignature")).alias("title"), time(F.col("startedAt")).alias("started_at"), time(F.col("updatedAt")).alias("updated_at"), F.map_filter(F.create_map(F.lit("captureSignature"), F.col("captureSignature"), F.lit("url"), urls.clean_url("url"), F.lit("site"), F.col("site"), F.lit("capturedAt"), F.col("capturedAt")), lambda k, v: v.isNotNull()).alias("metadata"))
    m = rows.select("conv_key", F.col("sourceId").alias("source_id"), F.posexplode("messages").alias("ord", "m"))
    texts = lambda items: F.transform(items, lambda x: F.to_json(x))
    messages = m.select("conv_key", "source_id", F.col("ord").cast("long").alias("ord"), F.col("m.upstreamId").alias("upstream_id"), F.col("m.role").alias("role"), time(F.col("m.createdAt")).alias("created_at"), time(F.col("m.updatedAt")).alias("updated_at"), urls.clean_images("m.text").alias("text"), urls.clean_images("m.thinking").alias("thinking"), F.col("m.modelId").alias("model_id"), clean_ids(F.col("m.upstreamIds")).alias("upstream_ids"), texts(urls.safe_attachments("m.attachments")).alias("attachments"), texts(urls.safe_citations("m.citations")).alias("citations"), texts(urls.safe_media("m.media")).alias("media"))
    told = rows.select(F.col("sourceId").alias("source_id"), F.explode_outer("diagnostics").alias("d"), F.col("conv_key").alias("evidence_ref")).filter("d is not null").select("source_id", "d.severity", "d.code", "d.message", "evidence_ref")
    return Batch.of(conversations, shaped(messages, MESSAGES), None, told)


def merge_captures(store: Store, rows: DataFrame, at: str) -> Store:
    return merge.merge_batch(store, captures_to_batch(parse_captures(rows)), "partial", at)


def start_capture_stream(spark: SparkSession, in_dir: str, store_dir: str, checkpoint: str, at: str = "1970-01-01T00:00:00.000Z", keep_versions: int = 50, **trigger):
    """Merge capture files as they arrive: each micro-batch is one partial import that writes the conversations it touches.

    A repeated batch after a failure merges the same rows again, which changes nothing. There is no cut-off for late rows. The store's
    last `keep_versions` versions stay, for readers that are still at them; a batch writes one, and one more where parts merge.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        store = export.read_store(session, store_dir) if export.latest_number(session, store_dir) is not None else Store.new(session)
        with temporary(session):
            export.write_change(merge.merge_change(store, captures_to_batch(parse_captures(batch)), "partial", at), store_dir)
        export.vacuum(session, store_dir, keep_versions)

    stream = spark.readStream.schema("value string").text(in_dir)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def daily_activity(rows: DataFrame, tz: str = "UTC", late: str = "2 days") -> DataFrame:
    """Streaming form of the day digest: rows per local day of a zone (with its summer time) and source of a
    (source_id, updated_at timestamp) stream, with a watermark; rows later than that are dropped from a day that is closed."""
    # Local clock time as a timestamp, so that a local day of 23 or 25 hours is one window.
    local = rows.withColumn("local", F.from_utc_timestamp("updated_at", tz))
    timed = local.withWatermark("local", late) if rows.isStreaming else local
    return timed.groupBy(F.window("local", "1 day").alias("w"), "source_id").agg(F.count("*").alias("n"), F.max("updated_at").alias("latest")).select(F.col("w.start").alias("day"), "source_id", "n", "latest")


def running_totals(rows: DataFrame) -> DataFrame:
    """Per source, how many messages and the latest time; on a stream in update or complete mode."""
    return rows.groupBy("source_id").agg(F.count("*").alias("messages"), F.max("updated_at").alias("updated_at"))
