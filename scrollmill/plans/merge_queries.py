"""Merging, identity, evidence, captures, URLs, JSON lines, files, backups and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.functions import urls
from scrollmill.functions import variants as V
from scrollmill.functions.times import iso
from scrollmill.operators import export, merge
from scrollmill.operators.batch import MESSAGES, Store, shaped
from scrollmill.plans.import_queries import claude_code_lines, js, put_lines, render_claude_code, render_codex, scratch
from scrollmill.plans.testbed import STORE_SQL, batch, messages, query, table, turns
from scrollmill.sources import base, claude_code, codex, pi
from scrollmill.streaming import captures
from scrollmill.streaming.refresh import Spec, refresh

AT = "2024-06-01T00:00:00.000Z"


@query("evidence_dedup", "SELECT 'raw_' || substr(sha256(source || chr(31) || sha256(text)), 1, 24) AS evidence_id, source AS source_id, sha256(text) AS content_hash, min('doc-' || doc_id) AS uri FROM documents GROUP BY source, text")
def evidence_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("source_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("uri"), F.col("text").alias("content"))
    return merge.dedup_evidence(rows).select("evidence_id", "source_id", "content_hash", "uri")


@query("evidence_link", "SELECT conv_id || '/' || turn AS upstream_id, 'raw_' || substr(sha256('src' || chr(31) || sha256(text)), 1, 24) AS evidence_id FROM conversations")
def evidence_link(spark, sf_dir):
    t = turns(spark, sf_dir)
    uri = F.concat("session", F.lit("#"), F.col("turn").cast("string"))
    rows = t.select(F.col("session").alias("batch_key"), F.lit("src").alias("source_id"), uri.alias("uri"), F.col("text").alias("content"))
    hashed = rows.withColumn("content_hash", merge.content_hash("content")).withColumn("evidence_id", merge.stable_id("raw", "source_id", "content_hash"))
    m = t.select(F.col("session").alias("batch_key"), F.concat_ws("/", "conv_id", "turn").alias("upstream_id"), uri.alias("evidence_uri"))
    return merge.link_evidence(m, hashed).select("upstream_id", "evidence_id")


@query("merge_messages", f"""WITH {STORE_SQL}, h AS (SELECT session, turn, role, text, turn AS ord, NULL AS model, 'a' || turn AS up FROM m WHERE turn <= 4 UNION ALL SELECT session, turn, role, text, 100 + turn, CASE WHEN turn % 2 = 0 THEN 'model-' || turn END, 'b' || turn FROM m WHERE turn >= 2)
SELECT session, 'm' || turn AS upstream_id, min(ord) AS ord, role, max(model) AS model_id, string_agg(up, ',' ORDER BY ord) AS upstream_ids FROM h GROUP BY session, turn, role, text""")
def merge_messages(spark, sf_dir):
    t = turns(spark, sf_dir)
    up = F.concat(F.lit("m"), F.col("turn").cast("string"))
    left = t.filter("turn <= 4").select(F.col("session").alias("conv_key"), up.alias("upstream_id"), F.col("turn").alias("ord"), "role", "created_at", "text", F.lit(None).cast("string").alias("model_id"), F.array(F.concat(F.lit("a"), F.col("turn"))).alias("upstream_ids"))
    right = t.filter("turn >= 2").select(F.col("session").alias("conv_key"), up.alias("upstream_id"), (F.col("turn") + 100).alias("ord"), "role", "created_at", "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("model-"), F.col("turn"))).alias("model_id"), F.array(F.concat(F.lit("b"), F.col("turn"))).alias("upstream_ids"))
    merged = merge.merge_messages(shaped(left.unionByName(right), MESSAGES))
    return merged.select(F.col("conv_key").alias("session"), "upstream_id", "ord", "role", "model_id", F.array_join("upstream_ids", ",").alias("upstream_ids"))


def stored(spark, sf_dir, keep=None) -> Store:
    """A store written to disk after one full import of some turns."""
    path = scratch(spark, "store")
    export.write_store(merge.merge_batch(Store.new(spark), batch(spark, sf_dir, keep), "full", AT), path)
    return export.read_store(spark, path)


SEEN = "id, upstream_id, source_id, started_at, updated_at, message_count"


@query("merge_partial", f"WITH {STORE_SQL}, p AS (SELECT conversation_id, strftime(strptime(max(created_at), '%Y-%m-%dT%H:%M:%S.000Z') + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS u FROM m WHERE turn >= 2 GROUP BY 1) SELECT id, upstream_id, source_id, started_at, greatest(c.updated_at, coalesce(u, '')) AS updated_at, message_count FROM c LEFT JOIN p ON p.conversation_id = c.id")
def merge_partial(spark, sf_dir):
    out = merge.merge_batch(stored(spark, sf_dir, "turn <= 3"), batch(spark, sf_dir, "turn >= 2", newer=1), "partial", AT)
    return out.conversations.selectExpr(*SEEN.split(", "))


@query("merge_full_prune", f"WITH {STORE_SQL} SELECT {SEEN} FROM c WHERE CAST(substr(upstream_id, 9) AS INT) % 4 <> 0")
def merge_full_prune(spark, sf_dir):
    out = merge.merge_batch(stored(spark, sf_dir), batch(spark, sf_dir, "conv_id % 4 <> 0"), "full", AT)
    return out.conversations.selectExpr(*SEEN.split(", "))


@query("merge_twice", f"WITH {STORE_SQL} SELECT message_id, conversation_id, role, created_at FROM m")
def merge_twice(spark, sf_dir):
    """The same partial batch over a store that holds it already changes no id."""
    return merge.merge_batch(stored(spark, sf_dir), batch(spark, sf_dir), "partial", AT).messages.select("message_id", "conversation_id", "role", "created_at")


ALIAS_URL = "'https://www.perplexity.ai/search/thread-' || conv_id"


@query("alias_resolve", "SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 2 THEN 'new' WHEN conv_id % 3 = 1 THEN 'signature' ELSE 'alias' END AS match, CASE WHEN conv_id % 3 = 2 THEN 'own-' ELSE 'stored-' END || conv_id AS conversation_id FROM conversations")
def alias_resolve(spark, sf_dir):
    """Stored under a page id, met again under the id of the URL, or by signature, or not at all."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    key = F.col("conv_id").cast("string")
    source = F.lit("browser-extension-perplexity").alias("source_id")
    url = F.concat(F.lit("https://www.perplexity.ai/search/thread-"), key)
    old = ids.filter("conv_id % 3 <> 2").select(F.concat(F.lit("stored-"), key).alias("id"), source, F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("sig-"), key)).alias("signature"), F.concat(F.lit("page_search_thread-"), key).alias("upstream_id"), url.alias("url"), F.lit(AT).alias("updated_at"))
    new = ids.select(key.alias("batch_key"), source, F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("sig-"), key)).alias("signature"), F.concat(F.lit("thread-"), key).alias("upstream_id"), F.when(F.col("conv_id") % 3 == 0, url).alias("url"), F.concat(F.lit("own-"), key).alias("own_id"))
    return merge.resolve_ids(new, old).select(F.col("batch_key").cast("long").alias("conv_id"), "match", "conversation_id")


CLEAN = r"regexp_replace(CASE WHEN regexp_matches(url, '^https?://[^/?#]+[?#]|^https?://[^/?#]+$') THEN regexp_extract(url, '^https?://[^/?#]+') || '/' ELSE regexp_extract(url, '^https?://[^?#]+') END, '^(https?://)[^/@]*@', '\1')"


@query("sanitize_urls", f"SELECT page_id, {CLEAN} AS clean FROM pages")
def sanitize_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.clean_url("url").alias("clean"))


@query("markdown_images", f"SELECT page_id, 'a ![p' || page_id || '](' || {CLEAN} || ') b ![x](removed:image) c ![](https://h.example/a(1).png)' AS text FROM pages")
def markdown_images(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("a ![p"), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(' "title") b ![x](javascript:alert) c ![](<https://h.example/a(1).png?k=1>)'))
    return p.select("page_id", urls.clean_images(text).alias("text"))


@query("media_filter", f"SELECT page_id, CAST(1 AS INT) AS n_attachments, 'image|' || {CLEAN} || CASE WHEN page_id % 2 = 0 THEN '' ELSE ',unknown|' END AS media, {CLEAN} AS citations FROM pages")
def media_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    item = lambda kind, title, url: F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), url.alias("url"), F.lit(None).cast("string").alias("thumbnail"), F.lit(-1.0).alias("width"))
    media = F.array(item("image", "t", F.col("url")), item("film", "t", F.when(F.col("page_id") % 2 == 0, F.lit("data:x"))), item("image", None, F.lit(None).cast("string")))
    linked = F.array(F.struct(F.lit("n").alias("name"), F.lit("t").alias("title"), F.col("url").alias("url")), F.struct(F.lit("n").alias("name"), F.lit("t").alias("title"), F.lit("javascript:x").alias("url")))
    return p.select("page_id", F.size(urls.safe_attachments(linked)).alias("n_attachments"), F.array_join(F.transform(urls.safe_media(media), lambda m: F.concat(m["type"], F.lit("|"), F.coalesce(m["url"], F.lit("")))), ",").alias("media"), F.array_join(F.transform(urls.safe_citations(linked), lambda c: c["url"]), ",").alias("citations"))


@query("site_match", "SELECT conv_id, turn, 'claude' AS site FROM conversations WHERE turn % 4 = 0 UNION ALL SELECT conv_id, turn, 'doubao' FROM conversations WHERE turn % 4 = 1")
def site_match(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 4).alias("k"))
    key = F.col("conv_id").cast("string")
    site = F.when(F.col("k").isin(0, 2), "claude").otherwise("doubao")
    url = F.when(F.col("k") == 0, F.concat(F.lit("https://claude.ai/chat/"), key)).when(F.col("k") == 1, F.concat(F.lit("https://www.doubao.com/chat/"), key)).when(F.col("k") == 2, F.concat(F.lit("http://claude.ai/chat/"), key)).otherwise(F.concat(F.lit("https://www.doubao.com/chat/local"), key))
    rows = t.select("conv_id", "turn", site.alias("site"), F.concat(F.lit("browser-extension-"), site).alias("source_id"), F.initcap(site).alias("source_label"), url.alias("url"))
    return urls.match_sites(rows, urls.sites(spark)).select("conv_id", "turn", "site")


def event_lines(spark, sf_dir) -> str:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 == 3, F.lit('{"k": ')).when(F.col("event_id") % 7 == 5, F.lit("[1]")).when(F.col("event_id") % 7 == 6, F.lit("  ")).otherwise(F.col("props"))
    return put_lines(e.select(F.col("event_type").alias("session"), F.col("event_id").alias("at"), value.alias("value")), scratch(spark, "events"), per_session=True)


@query("json_records", "WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, event_id, props FROM events), l AS (SELECT event_type, max(line) FILTER (event_id % 7 <> 6) AS last FROM e GROUP BY 1) SELECT event_type, CAST(line AS INT) AS line, CASE WHEN event_id % 7 NOT IN (3, 5) THEN 'record' WHEN line = last THEN 'events_trailing_record_incomplete' ELSE 'jsonl_malformed' END AS kind, CASE WHEN event_id % 7 NOT IN (3, 5) THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM e JOIN l USING (event_type) WHERE event_id % 7 <> 6")
def json_records(spark, sf_dir):
    base.tolerant(spark)
    records, bad = base.read_jsonl(base.text_lines(spark, event_lines(spark, sf_dir)), "events", tail="events")
    name = lambda p: F.regexp_extract(p, "session=([^/]+)/", 1).alias("event_type")
    good = records.select(name("path"), "line", F.lit("record").alias("kind"), V.number("v", "$.k").alias("k"))
    return good.unionByName(bad.select(name("evidence_ref"), F.regexp_extract("evidence_ref", "#L([0-9]+)$", 1).cast("int").alias("line"), F.col("code").alias("kind"), F.lit(None).cast("double").alias("k")))


@query("fingerprint", "SELECT event_type, substr(sha256('OBJECT<k: BIGINT>'), 1, 16) AS fingerprint FROM events GROUP BY 1")
def fingerprint(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("line"), V.parse("props").alias("v"))
    return base.fingerprint(e, "event_type")


@query("active_branch", f"WITH {STORE_SQL} SELECT session, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS branch FROM m WHERE conv_id % 5 <> 0 GROUP BY 1")
def active_branch(spark, sf_dir):
    """Parents are the turns before; every fourth turn has a sibling; some sessions run in a circle and are left out."""
    t = turns(spark, sf_dir)
    up = lambda k: F.concat(F.lit("e"), k.cast("string"))
    main = t.select(F.col("session").alias("path"), (F.col("turn") * 2 + 2).cast("int").alias("line"), up(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, up(F.col("turn") - 1)).when(F.col("conv_id") % 5 == 0, F.lit("e0")).alias("parent"), ((F.col("turn") == 0) & (F.col("conv_id") % 5 != 0)).alias("root"))
    side = t.filter("turn % 4 = 1").select(F.col("session").alias("path"), (F.col("turn") * 2 + 1).cast("int").alias("line"), F.concat(up(F.col("turn")), F.lit("x")).alias("id"), up(F.col("turn") - 1).alias("parent"), F.lit(False).alias("root"))
    none = F.lit(None).cast("string")
    entries = main.union(side).withColumns({"version": F.lit(3.0), "leaf": F.lit(False), "target": none, "target_null": F.lit(False)})
    walked = pi.branches(entries)
    kept = walked.filter("line > 0 and verdict = 'ok'")
    return kept.groupBy(F.col("path").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: ((x - 2) / 2).cast("int").cast("string")), ",").alias("branch"))


@query("incremental_files", "SELECT url AS path, page_id FROM pages WHERE page_id % 10 IN (0, 1, 2)")
def incremental_files(spark, sf_dir):
    """Of a file list, new (0), rewritten (1) and older (2) files."""
    p = table(spark, sf_dir, "pages")
    now = p.select(F.col("url").alias("path"), "page_id", F.length("html").cast("long").alias("length"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("modified"))
    k = F.col("page_id") % 10
    known = now.filter(k != 0).select("path", F.when(k == 1, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(k == 2, F.col("modified") + F.expr("interval 1 day")).otherwise(F.col("modified")).alias("modified"))
    return base.changed_files(now, known).select("path", "page_id")


def payloads(spark, sf_dir):
    """(conv_id, turn_group, value): two captures of each conversation, the second with all turns; some broken."""
    t = turns(spark, sf_dir).withColumn("last", F.max("turn").over(merge.Window.partitionBy("session")))
    both = t.filter("turn <= 1").withColumn("part", F.lit(0)).union(t.withColumn("part", F.lit(1)))
    said = F.struct("turn", F.struct(F.concat(F.lit("m"), F.col("turn")).alias("upstreamId"), "role", F.col("created_at").alias("createdAt"), "text").alias("m"))
    g = both.groupBy("conv_id", "session", "part").agg(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["m"]).alias("messages"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    site = F.lit("claude")
    version = F.when(F.col("conv_id") % 11 == 7, 2).otherwise(1)
    value = F.to_json(F.struct(version.alias("schemaVersion"), F.lit("browser-extension-claude").alias("sourceId"), F.lit("Claude").alias("sourceLabel"), site.alias("site"), F.col("session").alias("upstreamConversationId"), F.concat(F.lit("https://u:p@claude.ai/chat/"), F.col("conv_id").cast("string"), F.lit("?token=1#x")).alias("url"), F.col("session").alias("title"), F.concat(F.lit("2024-05-0"), (F.col("part") + 1).cast("string"), F.lit("T00:00:00.000Z")).alias("capturedAt"), F.col("a").alias("startedAt"), F.col("b").alias("updatedAt"), F.concat(F.lit("sig-"), F.col("session")).alias("captureSignature"), "messages"))
    return g.select("conv_id", "part", F.when((F.col("conv_id") % 11 == 5) & (F.col("part") == 0), F.lit('{"schemaVersion": 1, ')).otherwise(value).alias("value"))


@query("capture_valid", f"WITH {STORE_SQL} SELECT session AS upstream_id, 'https://claude.ai/chat/' || conv_id AS url, p.part, count(*) AS n FROM m, (VALUES (0), (1)) p(part) WHERE (p.part = 1 OR turn <= 1) AND conv_id % 11 <> 7 AND NOT (conv_id % 11 = 5 AND p.part = 0) GROUP BY ALL")
def capture_valid(spark, sf_dir):
    parsed = captures.parse_captures(payloads(spark, sf_dir).select("value"))
    b = captures.captures_to_batch(parsed)
    part = (F.substring(F.col("metadata")["capturedAt"], 10, 1).cast("int") - 1).alias("part")
    return b.messages.join(b.conversations.select("conv_key", F.col("upstream_id").alias("up"), F.col("metadata")["url"].alias("url"), part), "conv_key").groupBy(F.col("up").alias("upstream_id"), "url", "part").agg(F.count("*").alias("n"))


STREAM_SQL = f"WITH {STORE_SQL} SELECT session AS upstream_id, min(created_at) AS started_at, max(created_at) AS updated_at, count(*) AS message_count FROM m WHERE conv_id % 11 <> 7 GROUP BY session"


@query("stream_captures", STREAM_SQL)
def stream_captures(spark, sf_dir):
    """Both captures of each conversation arrive as files, in two micro-batches."""
    root = scratch(spark, "captures")
    rows = payloads(spark, sf_dir)
    for part in (0, 1):
        rows.filter(F.col("part") == part).select("value").write.mode("append").text(f"{root}/in")
        captures.start_capture_stream(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", AT, availableNow=True).awaitTermination()
    return export.read_store(spark, f"{root}/store").conversations.select("upstream_id", "started_at", "updated_at", "message_count")


def last_totals(spark, sf_dir, kind: str, aggregate) -> DataFrame:
    """The last output of an aggregate of the events as a stream, read back from its sink."""
    root = scratch(spark, kind)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("ts").cast("timestamp").alias("updated_at"))
    e.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")

    def last(frame, epoch):
        frame.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    aggregate(stream).writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{root}/out")
    return every.join(F.broadcast(every.agg(F.max("epoch").alias("epoch"))), "epoch").drop("epoch")


@query("stream_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS source_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    days = last_totals(spark, sf_dir, "daily", lambda rows: captures.daily_activity(rows, late="60 days"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source_id", "n")


@query("stream_daily_zone", "SELECT CAST(CAST(((ts + INTERVAL 60 DAY) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS day, event_type AS source_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_zone(spark, sf_dir):
    """Days of a zone, in a month in which its summer time begins."""
    later = lambda rows: rows.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 60 DAYS"))
    days = last_totals(spark, sf_dir, "daily-zone", lambda rows: captures.daily_activity(later(rows), "America/New_York", late="60 days"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source_id", "n")


@query("stream_totals", "SELECT event_type AS source_id, count(*) AS messages, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1")
def stream_totals(spark, sf_dir):
    totals = last_totals(spark, sf_dir, "totals", captures.running_totals)
    return totals.select("source_id", "messages", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("refresh_changed", f"WITH {STORE_SQL}, t AS (SELECT DISTINCT session, turn, role, created_at, text FROM m) SELECT 'claude-code' AS source_id, count(DISTINCT session) AS conversations, count(*) AS messages FROM t")
def refresh_changed(spark, sf_dir):
    """Logs that arrive in two parts, each session in both; the second look reads the new files only."""
    root = scratch(spark, "refresh")
    rows = claude_code_lines(spark, sf_dir)
    for part, keep in enumerate((F.col("at") < 20, F.col("at") >= 20)):
        put_lines(rows.filter(keep), f"{root}/logs/{part}")
        store = refresh(spark, f"{root}/store", [Spec("claude-code", f"{root}/logs")], AT, now=60.0 * part)
    return store.status.select("source_id", "conversations", "messages")


@query("backup_write", f"WITH {STORE_SQL} SELECT (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM m) AS messages, CAST(0 AS BIGINT) AS evidence, CAST(3 AS BIGINT) AS status, (SELECT count(*) FROM m) AS nested")
def backup_write(spark, sf_dir):
    store, path = stored(spark, sf_dir), scratch(spark, "backup")
    counts = export.write_backup(store, path, AT)
    nested = spark.read.json(f"{path}/conversations").select(F.sum(F.size("messages")).alias("nested")).first().nested
    return counts.select("conversations", "messages", "evidence", "status", F.lit(nested).alias("nested"))


@query("backup_counts", f"WITH {STORE_SQL} SELECT (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM m) AS messages, (SELECT count(DISTINCT source_id) FROM c) AS status")
def backup_counts(spark, sf_dir):
    return export.write_snapshot(stored(spark, sf_dir), scratch(spark, "snapshot")).select("conversations", "messages", "status")


@query("import_all", f"WITH {STORE_SQL}, t AS (SELECT DISTINCT session, turn, role, created_at, text FROM m) SELECT x.source_id, count(DISTINCT session) AS conversations, count(*) AS messages FROM t, (VALUES ('claude-code'), ('codex')) x(source_id) GROUP BY 1")
def import_all(spark, sf_dir):
    """Two sources into one store, imported twice: as full, then as partial."""
    both = [claude_code.read(spark, render_claude_code(spark, sf_dir)), codex.read(spark, render_codex(spark, sf_dir))]
    path, store = scratch(spark, "store"), Store.new(spark)
    for scope in ("full", "partial"):
        for b in both:
            export.write_store(merge.merge_batch(store, b, scope, AT), path)
            store = export.read_store(spark, path)
    return store.status.select("source_id", "conversations", "messages")


@query("import_together", f"WITH {STORE_SQL}, t AS (SELECT DISTINCT session, turn, role, created_at, text FROM m) SELECT x.source_id, count(DISTINCT session) AS conversations, count(*) AS messages FROM t, (VALUES ('claude-code'), ('codex')) x(source_id) GROUP BY 1")
def import_together(spark, sf_dir):
    """Two sources, whose sessions have the same names, merged by one plan into one version of a store."""
    both = merge.together([claude_code.read(spark, render_claude_code(spark, sf_dir)), codex.read(spark, render_codex(spark, sf_dir))])
    path = scratch(spark, "store")
    export.write_change(merge.merge_change(Store.new(spark), both, "full", AT), path)
    return export.read_store(spark, path).status.select("source_id", "conversations", "messages")
