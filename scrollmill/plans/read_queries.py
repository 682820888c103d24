"""Store shape, day digests, windows, open, totals, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollmill.functions.times import iso
from scrollmill.operators import export, recall, status
from scrollmill.operators.windows import keep_first, message_windows
from scrollmill.plans.testbed import STORE_SQL, conversations, messages, query, table, turns


@query("store_conversations", f"WITH {STORE_SQL} SELECT id, source_id, upstream_id, title, started_at, updated_at, message_count FROM c")
def store_conversations(spark, sf_dir):
    return conversations(spark, sf_dir).select("id", "source_id", "upstream_id", "title", "started_at", "updated_at", "message_count")


@query("store_messages", f"WITH {STORE_SQL} SELECT message_id, conversation_id, role, created_at, text FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, role, created_at, text ORDER BY turn) AS r FROM m) WHERE r = 1")
def store_messages(spark, sf_dir):
    return keep_first(messages(spark, sf_dir), ["conversation_id", "role", "created_at", "text"], "turn").select("message_id", "conversation_id", "role", "created_at", "text")


@query("source_totals", f"WITH {STORE_SQL}, d AS (SELECT source AS source_id, count(DISTINCT text) AS evidence FROM documents GROUP BY 1), a AS (SELECT source_id, count(*) AS conversations, CAST(sum(message_count) AS BIGINT) AS messages FROM c GROUP BY 1) SELECT coalesce(a.source_id, d.source_id) AS source_id, coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages, coalesce(evidence, 0) AS evidence FROM a FULL JOIN d ON a.source_id = d.source_id")
def source_totals(spark, sf_dir):
    evidence = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("source").alias("source_id"), "text").distinct()
    return status.source_totals(conversations(spark, sf_dir), messages(spark, sf_dir), evidence)


@query("import_totals", f"WITH {STORE_SQL} SELECT source_id, count(DISTINCT session) AS conversations, count(*) AS messages FROM m GROUP BY ROLLUP (source_id)")
def import_totals(spark, sf_dir):
    return status.import_totals(turns(spark, sf_dir).withColumnRenamed("session", "conv_key"))


@query("today_top8", f"WITH {STORE_SQL} SELECT id, source_id, title, started_at, updated_at FROM c WHERE (updated_at >= '2024-01-03T08:00:00.000Z' AND updated_at < '2024-01-04T08:00:00.000Z') OR (started_at >= '2024-01-03T08:00:00.000Z' AND started_at < '2024-01-04T08:00:00.000Z') ORDER BY updated_at DESC, id LIMIT 8")
def today_top8(spark, sf_dir):
    return recall.today(conversations(spark, sf_dir), "2024-01-03", "America/Los_Angeles").select("id", "source_id", "title", "started_at", "updated_at")


DIGEST_SQL = f"""WITH {STORE_SQL}, s AS (SELECT DISTINCT id, updated_at, title, unnest([CAST(substr(started_at, 1, 10) AS DATE), CAST(substr(updated_at, 1, 10) AS DATE)]) AS day FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY updated_at DESC, id) AS INT) AS rank FROM s)"""


@query("daily_digest", f"{DIGEST_SQL} SELECT CAST(day AS VARCHAR) AS day, rank, id, title, updated_at FROM r WHERE rank <= 8")
def daily_digest(spark, sf_dir):
    return recall.daily_digest(conversations(spark, sf_dir)).select(F.col("day").cast("string"), "rank", "id", "title", "updated_at")


@query("day_summaries", f"{DIGEST_SQL} SELECT CAST(day AS VARCHAR) AS day, count(*) || CASE WHEN count(*) = 1 THEN ' session' ELSE ' sessions' END || ' touched this date.' AS summary, string_agg('open ' || id, '|' ORDER BY rank) FILTER (rank <= 3) AS hints FROM r WHERE rank <= 8 GROUP BY day")
def day_summaries(spark, sf_dir):
    return recall.day_summaries(recall.daily_digest(conversations(spark, sf_dir))).withColumn("hints", F.array_join("hints", "|")).withColumn("day", F.col("day").cast("string"))


@query("local_day_la", "SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-05 08:00:00' AND ts < TIMESTAMP '2024-01-06 08:00:00' GROUP BY 1")
def local_day_la(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("updated_at", iso("ts"))
    return recall.filter_local_day(rows, "2024-01-05", "America/Los_Angeles").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("message_window", f"WITH {STORE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, message_id) AS rn FROM m) SELECT a.message_id AS anchor_id, n.message_id, n.text, CAST(n.rn - a.rn AS INT) AS off FROM n JOIN n a ON n.conversation_id = a.conversation_id AND abs(n.rn - a.rn) <= 1 + a.turn % 2")
def message_window(spark, sf_dir):
    m = messages(spark, sf_dir)
    anchors = m.select("conversation_id", "message_id", (1 + F.col("turn") % 2).cast("int").alias("context"))
    return message_windows(m, anchors).select("anchor_id", "message_id", "text", (F.col("rn") - F.col("at")).alias("off"))


@query("open_prefix", f"WITH {STORE_SQL}, p AS (SELECT DISTINCT substr(id, 1, 7) AS prefix FROM c UNION SELECT DISTINCT substr(id, 1, 12) FROM c UNION SELECT 'conv_zz') SELECT prefix, CASE count(id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM p LEFT JOIN c ON starts_with(c.id, p.prefix) GROUP BY prefix")
def open_prefix(spark, sf_dir):
    c = conversations(spark, sf_dir)
    prefixes = c.select(F.substring("id", 1, 7).alias("prefix")).union(c.select(F.substring("id", 1, 12))).union(spark.range(1).select(F.lit("conv_zz")))
    return recall.open_many(c, messages(spark, sf_dir), prefixes)


@query("backup_nested", f"WITH {STORE_SQL} SELECT c.id, c.title, string_agg(m.message_id || ':' || m.role, '|' ORDER BY m.created_at, m.message_id) AS messages FROM c JOIN m ON m.conversation_id = c.id GROUP BY c.id, c.title")
def backup_nested(spark, sf_dir):
    nested = export.nest_conversations(conversations(spark, sf_dir), messages(spark, sf_dir).select("conversation_id", "created_at", "message_id", "role", "text"))
    return nested.select("id", "title", F.array_join(F.transform("messages", lambda m: F.concat(m["message_id"], F.lit(":"), m["role"])), "|").alias("messages"))


#: Events as diagnostics: codes and severities by event type, counts in the message.
DIAG_SQL = """d AS (SELECT 'src-' || (user_id % 5) AS source_id, CASE WHEN value > 90 THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity,
  CASE event_id % 4 WHEN 0 THEN 'codex_no_messages' WHEN 1 THEN 'pi_no_messages' WHEN 2 THEN 'claude_code_events_unmapped' ELSE 'jsonl_malformed' END AS code,
  (event_id % 7) || ' things at ' || event_type AS message, 'ref-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS evidence_ref, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract(ms FROM ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS created_at, event_id FROM events)"""


def diagnostics_of_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*[F.lit(c) for c in ("codex_no_messages", "pi_no_messages", "claude_code_events_unmapped", "jsonl_malformed")]), (F.col("event_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("value") > 90, "error").when(F.col("value") > 50, "warning").otherwise("info")
    return e.select(
        F.concat(F.lit("src-"), (F.col("user_id") % 5).cast("string")).alias("source_id"),
        severity.alias("severity"),
        code.alias("code"),
        F.concat((F.col("event_id") % 7).cast("string"), F.lit(" things at "), F.col("event_type")).alias("message"),
        F.concat(F.lit("ref-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("evidence_ref"),
        iso("ts").alias("created_at"),
        F.col("event_id").cast("string").alias("id"),
    )


@query("diagnostics_summary", f"""WITH {DIAG_SQL}, g AS (SELECT source_id, severity, code, count(*) AS n, sum(CAST(split_part(message, ' ', 1) AS BIGINT)) AS k, min(message) AS one, min(evidence_ref) AS evidence_ref FROM d WHERE code <> 'jsonl_malformed' GROUP BY 1, 2, 3)
SELECT source_id, severity, code, CASE WHEN n = 1 THEN one ELSE n || ' ' || code || ' diagnostics were summarized.' || CASE WHEN k > 0 THEN ' ' || k || ' source events or conversations were skipped.' ELSE '' END END AS message, evidence_ref FROM g
UNION ALL SELECT source_id, severity, code, message, evidence_ref FROM d WHERE code = 'jsonl_malformed'""")
def diagnostics_summary(spark, sf_dir):
    return status.summarize_diagnostics(diagnostics_of_events(spark, sf_dir).select("source_id", "severity", "code", "message", "evidence_ref"))


@query("health_rollup", f"WITH {DIAG_SQL}, p AS (SELECT * FROM (VALUES ('src-0', 'absent'), ('src-1', 'partial'), ('src-2', 'healthy')) t(source_id, health)), g AS (SELECT source_id, bool_or(severity = 'error' AND event_id % 3 = 0 AND source_id <> 'src-0') AS failed FROM d GROUP BY 1) SELECT g.source_id, CASE WHEN failed THEN 'partial' ELSE coalesce(health, 'healthy') END AS health FROM g LEFT JOIN p USING (source_id)")
def health_rollup(spark, sf_dir):
    previous = spark.createDataFrame([("src-0", "absent"), ("src-1", "partial"), ("src-2", "healthy")], "source_id string, health string")
    rows = diagnostics_of_events(spark, sf_dir)
    failed = (F.col("severity") == "error") & (F.col("id").cast("long") % 3 == 0) & (F.col("source_id") != "src-0")
    return status.roll_up_health(rows.select("source_id", failed.alias("failed")), previous, "partial")


@query("sources_report", f"WITH {DIAG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, CAST(event_id AS VARCHAR)) AS k FROM d) SELECT source_id, count(*) AS n, string_agg(code || ':' || message, '|' ORDER BY k) AS newest FROM r WHERE k <= 50 GROUP BY 1")
def sources_report(spark, sf_dir):
    rows = diagnostics_of_events(spark, sf_dir)
    found = recall.sources(rows.select("source_id").distinct(), rows)
    return found.select("source_id", F.size("diagnostics").cast("long").alias("n"), F.array_join(F.transform("diagnostics", lambda d: F.concat(d["code"], F.lit(":"), d["message"])), "|").alias("newest"))


@query("best_candidate", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best_candidate(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")])
