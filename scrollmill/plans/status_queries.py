"""Coverage, health, diagnostics of imports, evidence, duplicates, late captures, stored search, backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollmill.functions import text as T
from scrollmill.functions import variants as V
from scrollmill.functions.urls import conversation_uri
from scrollmill.operators import export, merge, recall, search
from scrollmill.operators.batch import Batch, Store
from scrollmill.plans.import_queries import claude_code_lines, js, put_lines, render_claude_code, render_cursor, render_grok, scratch, shown
from scrollmill.plans.merge_queries import AT, STREAM_SQL, payloads, stored
from scrollmill.plans.testbed import STORE_SQL, batch, conversations, query, table, turns
from scrollmill.sources import claude_code, cursor, grok_build, pi
from scrollmill.streaming import captures
from scrollmill.streaming.refresh import Spec, import_all

BLANK = r"NOT regexp_matches(text, '\S')"


@query("import_diagnostics", rf"WITH {STORE_SQL}, s AS (SELECT 1 + CASE WHEN {BLANK} THEN 1 + CASE WHEN turn = 1 THEN 1 ELSE 0 END ELSE 0 END AS k, session FROM m) SELECT 'error' AS severity, 'jsonl_malformed' AS code, count(DISTINCT session) AS n FROM s UNION ALL SELECT 'info', 'claude_code_events_unmapped', CAST(sum(k) AS BIGINT) FROM s")
def import_diagnostics(spark, sf_dir):
    """Broken lines count one each, skipped records by the numbers that their messages start with."""
    told = claude_code.read(spark, render_claude_code(spark, sf_dir)).diagnostics
    count = F.coalesce(F.nullif(F.regexp_extract("message", r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return told.groupBy("severity", "code").agg(F.sum(count).alias("n"))


@query("cursor_counters", f"WITH {STORE_SQL}, f AS (SELECT session, conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS said, count(*) FILTER (role IN ('user', 'assistant') AND turn < 2) AS early FROM m GROUP BY ALL), c1 AS (SELECT 'cursor_duplicates_deduplicated' AS code, sum((conv_id % 3 = 0 AND early > 0)::INT + (conv_id % 5 = 0 AND said > 0)::INT) AS n FROM f UNION ALL SELECT 'cursor_transcript_invalid', count(*) FILTER (conv_id % 5 = 0 AND said > 0) FROM f) SELECT code, CAST(n AS BIGINT) AS n FROM c1 WHERE n > 0")
def cursor_counters(spark, sf_dir):
    """Copies of transcripts and broken ones, as the import tells of them."""
    told = cursor.read(spark, render_cursor(spark, sf_dir)).diagnostics
    number = F.regexp_extract("message", r"^(\d+)", 1).cast("long")
    return told.filter(F.col("code").isin("cursor_duplicates_deduplicated", "cursor_transcript_invalid")).select("code", number.alias("n"))


@query("grok_hidden", f"WITH {STORE_SQL} SELECT DISTINCT session FROM m WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S') AND conv_id % 6 NOT IN (4, 5)")
def grok_hidden(spark, sf_dir):
    """Sessions whose summary says hidden, or names a subagent and does not say shown, are left out."""
    kind = F.when(F.col("conv_id") % 6 == 4, "subagent_task").when(F.col("conv_id") % 6 == 3, "subagent_shown")
    hidden = F.when(F.col("conv_id") % 6 == 5, True).when(F.col("conv_id") % 6 == 3, False)
    root = render_grok(spark, sf_dir, summaries=False)
    summary = turns(spark, sf_dir).filter("turn = 0").select("session", F.lit(0).alias("at"), js(info=F.struct(F.col("session").alias("id")), hidden=hidden, session_kind=kind).alias("value"))
    side = put_lines(summary, f"{scratch(spark, 'hidden')}/summary", per_session=True)
    return grok_build.read(spark, f"{root}/updates", side).conversations.select(F.col("upstream_id").alias("session"))


@query("history_titles", f"WITH {STORE_SQL} SELECT session, CASE WHEN conv_id % 2 = 0 THEN 'Asked ' || session END AS title FROM m WHERE conv_id % 2 = 0 GROUP BY ALL")
def history_titles(spark, sf_dir):
    """Titles of the log of prompts beside the sessions."""
    t = turns(spark, sf_dir).filter("turn = 0 and conv_id % 2 = 0")
    side = put_lines(t.select("session", F.lit(0).alias("at"), js(sessionId=F.col("session"), display=F.concat(F.lit("Asked  "), "session")).alias("value")), scratch(spark, "history"))
    found = shown(claude_code.read(spark, render_claude_code(spark, sf_dir), side))
    return found.filter(F.col("title").startswith("Asked")).select("session", "title").distinct()


@query("pi_visible", r"SELECT doc_id, regexp_replace(CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) END || '[image]' || chr(10) || 'see [file] and [file]', '^\s+|\s+$', '', 'g') AS shown FROM documents")
def pi_visible(spark, sf_dir):
    """Text, an image and file bodies, one of them cut, as a user's prompt shows them."""
    d = table(spark, sf_dir, "documents")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    files = F.concat(F.lit('see <file name="a.txt">\nbody '), F.col("doc_id").cast("string"), F.lit('</file> and <file name="b">tail'))
    content = F.to_json(F.array(part("text", F.coalesce("text", F.lit(""))), part("image", F.lit(None).cast("string")), part("other", F.lit("hidden")), part("text", files)))
    return d.select("doc_id", pi.visible(V.parse(content), F.lit(True)).alias("shown"))


@query("session_titles", "SELECT conv_id, 'Tool session ' || CASE WHEN conv_id % 2 = 0 THEN '2024-01-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || ' 07:30' ELSE 'a-session-without-a-t...' END AS title FROM (SELECT DISTINCT conv_id FROM conversations)")
def session_titles(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    day = F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("log-2024-01-"), day, F.lit("T07-30-00-x"))).otherwise(F.concat(F.lit("a-session-without-a-time-"), F.col("conv_id").cast("string")))
    return ids.withColumn("name", name).select("conv_id", T.session_title(F.lit("Tool"), "name").alias("title"))


@query("string_arrays", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || '|b' ELSE '' END AS items FROM conversations")
def string_arrays(spark, sf_dir):
    """Texts of JSON arrays; what is no array, or no text, or blank gives nothing."""
    t = table(spark, sf_dir, "conversations")
    value = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('["'), "role", F.lit('", " ", 5, null, "b"]'))).when(F.col("turn") % 3 == 1, F.lit('{"a": 1}')).otherwise(F.lit("[broken"))
    return t.select("conv_id", "turn", F.array_join(V.strings(V.parse(value)), "|").alias("items"))


@query("uris", "SELECT conv_id, 'history://conversation/a%20b%2F' || conv_id AS uri FROM (SELECT DISTINCT conv_id FROM conversations)")
def uris(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", conversation_uri(F.concat(F.lit("a b/"), F.col("conv_id").cast("string"))).alias("uri"))


@query("source_filter", f"WITH {STORE_SQL} SELECT id, source_id FROM c WHERE source_id IN ('src-a', 'src-c')")
def source_filter(spark, sf_dir):
    return recall.filter_source(conversations(spark, sf_dir), ["src-a", "src-c"]).select("id", "source_id")


def proven(spark, sf_dir, keep: str) -> Batch:
    """A batch whose turns are evidence, too, with a diagnostic for each session."""
    b = batch(spark, sf_dir, keep)
    t = turns(spark, sf_dir).filter(keep)
    proof = t.select(F.col("session").alias("conv_key"), "source_id", F.col("turn").cast("long").alias("ord"), F.concat("session", F.lit("#"), F.col("turn").cast("string")).alias("uri"), F.col("text").alias("content"))
    told = t.select("source_id", F.lit("warning").alias("severity"), F.lit("odd").alias("code"), F.lit("An odd session.").alias("message"), F.col("session").alias("evidence_ref")).distinct()
    return Batch.of(b.conversations, b.messages, proof, told)


@query("evidence_reset", f"WITH {STORE_SQL} SELECT source_id, count(DISTINCT text) AS evidence, count(DISTINCT session) AS diagnostics, count(DISTINCT text) AS counted FROM m WHERE conv_id % 4 <> 0 GROUP BY 1")
def evidence_reset(spark, sf_dir):
    """A full import replaces the evidence and the diagnostics of its sources; a partial one of the same rows adds none."""
    store = Store.new(spark)
    for keep, scope in (("true", "full"), ("conv_id % 4 <> 0", "full"), ("conv_id % 4 = 1", "partial")):
        path = scratch(spark, "store")
        export.write_store(merge.merge_batch(store, proven(spark, sf_dir, keep), scope, AT), path)
        store = export.read_store(spark, path)
    told = store.diagnostics.groupBy("source_id").agg(F.count("*").alias("diagnostics"))
    proof = store.evidence.groupBy("source_id").agg(F.count("*").alias("evidence"))
    return proof.join(told, "source_id").join(store.status.select("source_id", F.col("evidence").alias("counted")), "source_id")


@query("duplicates_removed", "SELECT DISTINCT 'thr-' || conv_id AS id, CAST(1 AS BIGINT) AS message_count FROM conversations")
def duplicates_removed(spark, sf_dir):
    """Each conversation is stored under its thread id and, by mistake, under its page's; the next import leaves the first."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    key, source = F.col("conv_id").cast("string"), F.lit("browser-extension-perplexity").alias("source_id")
    url, thread = F.concat(F.lit("https://www.perplexity.ai/search/thread-"), key), F.concat(F.lit("thread-"), key)
    common = [source, F.lit("P").alias("source_label"), F.lit(AT).alias("started_at"), F.lit(AT).alias("updated_at"), key.alias("title")]
    old = ids.select(F.concat(F.lit("thr-"), key).alias("id"), thread.alias("upstream_id"), F.lit(None).cast("string").alias("url"), *common)
    old = old.unionByName(ids.select(F.concat(F.lit("page-"), key).alias("id"), F.concat(F.lit("page_search_"), thread).alias("upstream_id"), url.alias("url"), *common))
    store = Store.new(spark)
    store.conversations = merge.shaped(old.withColumn("message_count", F.lit(0)), merge.STORE["conversations"])
    new = Batch.of(ids.select(key.alias("conv_key"), thread.alias("upstream_id"), F.create_map(F.lit("url"), url).alias("metadata"), *common), ids.select(key.alias("conv_key"), source, F.lit(0).alias("ord"), F.lit("m").alias("upstream_id"), F.lit("user").alias("role"), F.lit(AT).alias("created_at"), key.alias("text")))
    return merge.merge_batch(store, new, "partial", AT).conversations.select("id", "message_count")


@query("late_captures", STREAM_SQL)
def late_captures(spark, sf_dir):
    """The capture with all turns comes first, the older one with the first turns late: nothing is lost."""
    root, rows = scratch(spark, "late"), payloads(spark, sf_dir)
    for part in (1, 0):
        rows.filter(F.col("part") == part).select("value").write.mode("append").text(f"{root}/in")
        captures.start_capture_stream(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", AT, availableNow=True).awaitTermination()
    return export.read_store(spark, f"{root}/store").conversations.select("upstream_id", "started_at", "updated_at", "message_count")


@query("source_coverage", f"WITH {STORE_SQL} SELECT source_id, upper(source_id) AS label, 'healthy' AS health, '{AT}' AS last_import_at, count(*) AS conversations, CAST(sum(message_count) AS BIGINT) AS messages FROM c GROUP BY 1")
def source_coverage(spark, sf_dir):
    """What stands beside the sessions of a day: all sources and how far they are read."""
    _, coverage = recall.today_with_coverage(stored(spark, sf_dir), "2024-01-02")
    return coverage.select("source_id", "label", "health", "last_import_at", "conversations", "messages")


ASKED = ((0, "the", "src-a"), (1, "thing", "src-b"), (2, "que", "src-c"), (3, "licensed", "src-a"))
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STORED_SQL = rf"""q AS (SELECT * FROM (VALUES {', '.join(map(str, ASKED))}) v(query_id, token, src)),
mm AS (SELECT m.message_id, m.conversation_id, c.source_id, c.updated_at, m.created_at, c.title, m.text, regexp_extract_all(lower(strip_accents(c.title || ' ' || m.text)), '[\p{{L}}\p{{N}}]+') AS w FROM m JOIN c ON c.id = m.conversation_id),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM mm), f AS (SELECT query_id, src, mm.*, len(list_filter(w, lambda x: x = token)) AS tf FROM q, mm WHERE list_contains(w, token)),
df AS (SELECT query_id, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT f.query_id, message_id, conversation_id, updated_at, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))) AS score FROM f JOIN df USING (query_id), st WHERE source_id = src),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, updated_at DESC, message_id) AS row FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY row) AS own FROM r WHERE row <= 50),
ranked AS (SELECT query_id, message_id, conversation_id, score, row_number() OVER (PARTITION BY query_id ORDER BY row) AS rank FROM o WHERE own = 1),
h AS (SELECT q.query_id, conversation_id, message_id, updated_at, row_number() OVER (PARTITION BY q.query_id, conversation_id ORDER BY created_at DESC, message_id) AS own FROM q, mm WHERE source_id = src AND (contains({LOW.format('title')}, token) OR contains({LOW.format('text')}, token))),
sub AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, conversation_id) AS rank FROM h WHERE own = 1),
two AS (SELECT query_id, conversation_id, message_id, score, 0 AS stage, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, conversation_id, message_id, 0.0, 1, rank FROM sub WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= 10 AND r.query_id = sub.query_id AND r.conversation_id = sub.conversation_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank) AS place FROM two)"""


@query("search_stored", f"WITH {STORE_SQL}, {STORED_SQL} SELECT CAST(query_id AS INT) AS query_id, CAST(place AS INT) AS rank, conversation_id, message_id, round(score, 6) AS score FROM p WHERE place <= 10")
def search_stored(spark, sf_dir):
    """Single queries with a source filter over a store in two parts and the index beside it, which is brought up to date."""
    path = scratch(spark, "store")
    export.write_change(merge.merge_change(Store.new(spark), batch(spark, sf_dir, "turn <= 2"), "full", AT), path)
    search.store_index(spark, path)
    export.write_change(merge.merge_change(export.read_store(spark, path), batch(spark, sf_dir), "partial", AT), path)
    index, store = search.store_index(spark, path), export.read_store(spark, path)
    out = None
    for query_id, token, source in ASKED:
        found, _ = search.search_with_coverage(store, index, token, source, limit=10)
        part = found.select(F.lit(query_id).alias("query_id"), "rank", "conversation_id", "message_id", F.round("score", 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


@query("changed_counts", f"WITH {STORE_SQL}, t AS (SELECT DISTINCT session, turn, role, created_at, text FROM m WHERE regexp_matches(text, '\\S')), a AS (SELECT count(DISTINCT session) AS c, count(*) AS k FROM t) SELECT 'claude-code' AS source_id, c AS changed_conversations, k AS changed_messages, CAST(0 AS BIGINT) AS skipped_records, 'healthy|stable' AS status FROM a UNION ALL SELECT 'pi', 0, 0, 0, 'absent|stable'")
def changed_counts(spark, sf_dir):
    """What an import says of each source: how much it changed; one source has no files and was never there."""
    root = put_lines(claude_code_lines(spark, sf_dir).filter("at % 10 = 0"), scratch(spark, "logs"))
    store, _, report = import_all(spark, Store.new(spark), [Spec("claude-code", root), Spec("pi", root + "-none")], AT)
    return report.join(store.status.select("source_id", F.concat_ws("|", "health", "confidence").alias("status")), "source_id")


@query("backup_sections", f"WITH {STORE_SQL} SELECT 'header' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM m UNION ALL SELECT 'conversations', count(*) FROM c UNION ALL SELECT 'messages', count(*) FROM m UNION ALL SELECT 'evidence', count(DISTINCT (source_id, text)) FROM m UNION ALL SELECT 'diagnostics', count(*) FROM c UNION ALL SELECT 'in order', count(*) FROM c UNION ALL SELECT 'same checksum', 1")
def backup_sections(spark, sf_dir):
    """A backup's sections, its conversations newest first over all shards, and a checksum that another order of rows leaves alone."""
    path = scratch(spark, "store")
    export.write_store(merge.merge_batch(Store.new(spark), proven(spark, sf_dir, "true"), "full", AT), path)
    store, out = export.read_store(spark, path), scratch(spark, "backup")
    export.write_backup(store, out, AT)
    read = lambda name: spark.read.json(f"{out}/{name}")
    count = lambda df, name: df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
    c = read("conversations").select("id", "updated_at", F.size("messages").alias("size"), F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("shard"))
    shards = c.groupBy("shard").agg(F.min("updated_at").alias("low"), F.max("updated_at").alias("high"), F.count("*").alias("n"))
    ranked = shards.withColumn("before", F.lag("low").over(merge.Window.orderBy("shard")))  # a row for each shard
    order = ranked.agg(F.lit("in order").alias("section"), F.sum(F.when(F.col("before").isNull() | (F.col("before") >= F.col("high")), F.col("n")).otherwise(0)).alias("n"))
    shuffled = Store(*[getattr(store, f.name).repartition(3) for f in export.fields(store)])
    same = read("header").join(export.backup_counts(shuffled).select(F.col("checksum").alias("other")), F.col("checksum") == F.col("other"))
    parts = [count(read(n), n) for n in ("header", "sources", "evidence", "diagnostics")] + [count(c, "conversations"), c.agg(F.lit("messages").alias("section"), F.sum("size").alias("n")), order, count(same, "same checksum")]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every

