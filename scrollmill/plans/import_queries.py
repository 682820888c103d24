"""Round trips: the turns rendered in each source's raw format, with junk, then imported."""

from __future__ import annotations

import os
import re
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill import sources as _sources  # noqa: F401
from scrollmill.operators.batch import Batch
from scrollmill.operators.batch import shared_path as scratch
from scrollmill.plans.testbed import STORE_SQL, query, table, turns
from scrollmill.sources import base, claude_code, claude_web, codex, copilot, cursor, grok_build, kimi_code, opencode, pi


def js(**fields):
    """A JSON object of columns; nulls are left out."""
    return F.to_json(F.struct(*[(v if not isinstance(v, (str, int, bool)) else F.lit(v)).alias(k) for k, v in fields.items()]))


def block(text):
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def put_lines(rows: DataFrame, path: str, per_session: bool = False) -> str:
    """Write (session, at, value) as text, in order of (session, at); one file per session, or several sessions in each of some files."""
    if per_session:
        put_files(rows.sparkSession, rows.select("session", "at", "value"), path, "session")
    else:
        rows.repartition(4, "session").sortWithinPartitions("session", "at").select("value").write.text(path)
    return path


def put_files(spark: SparkSession, rows: DataFrame, path: str, *folders: str) -> None:
    """One file per session, since at most one task holds it; all cores write.

    In a local folder the tasks write the files themselves: without Hadoop's native code its local file system starts a process for each file, checksum and folder to set their modes.
    """
    dealt = rows.repartition(max(8, spark.sparkContext.defaultParallelism), "session").sortWithinPartitions("session", "at").select(*folders, "value")
    if re.match("file:|/", path):
        root = "/" + path.removeprefix("file:").lstrip("/")
        dealt.mapInArrow(lambda batches: local_files(batches, root, folders), "files long").agg(F.sum("files")).collect()
    else:
        dealt.write.partitionBy(*folders).text(path)


def local_files(batches, root: str, folders: tuple[str, ...]):
    """Write (*folders, value) rows, sorted by folders, as Spark's text writer does, a file in each folder; a file gets its name when it is whole."""
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get()
    name, private = f"part-{task.partitionId():05d}.txt", f".part-{task.taskAttemptId()}"
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    n = 0
    for n, (keys, group) in enumerate(groupby(rows, key=lambda r: [k or None for k in r[:-1]]), 1):
        folder = os.path.join(root, *[f"{f}={partition_name(k)}" for f, k in zip(folders, keys)])
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{private}", "w", encoding="utf-8", newline="") as out:
            out.writelines(f"{r[-1] or ''}\n" for r in group)
        os.replace(f"{folder}/{private}", f"{folder}/{name}")
    yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})


def partition_name(value: str | None) -> str:
    """A value as the name of its partition folder."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def lines(spark: SparkSession, sf_dir: str, *kinds) -> DataFrame:
    """(session, at, value) of some renderings (offset, filter, value) of every turn."""
    t = turns(spark, sf_dir).withColumn("ms", F.unix_millis(F.col("created_at").cast("timestamp"))).withColumn("last", F.max("turn").over(Window.partitionBy("session")))
    out = None
    for offset, keep, value in kinds:
        part = t.filter(keep).select("session", (F.col("turn") * 10 + offset).alias("at"), value.alias("value"))
        out = part if out is None else out.union(part)
    return out


def shown(b: Batch) -> DataFrame:
    """session, title, started_at, updated_at and the messages in order, numbered."""
    m = b.messages.withColumn("n", F.row_number().over(Window.partitionBy("conv_key").orderBy("ord")))
    c = b.conversations.select("conv_key", F.col("upstream_id").alias("session"), "title", "started_at", "updated_at")
    return c.join(m.select("conv_key", "n", "role", "created_at", "text"), "conv_key").drop("conv_key")


def expected(roles: str = "role IS NOT NULL", start: str = "min(created_at)", end: str = "max(created_at)", title: str | None = None, created: str = "created_at", label: str = "") -> str:
    """SQL of `shown` straight from the turns."""
    t = "trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_min(text, turn)), '\\s+', ' ', 'g'))"
    name = title or f"CASE WHEN length({t}) > 72 THEN substr({t}, 1, 69) || '...' ELSE {t} END"
    return f"""WITH {STORE_SQL}, k AS (SELECT conv_id, session, turn, role, {created} AS created_at, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM m WHERE ({roles}) AND regexp_matches(text, '\\S')),
    h AS (SELECT session, {name} AS title, {start} AS started_at, {end} AS updated_at FROM k GROUP BY session, conv_id)
    SELECT session, title, started_at, updated_at, CAST(row_number() OVER (PARTITION BY session ORDER BY turn) AS INT) AS n, role, created_at, text FROM k JOIN h USING (session)"""


def claude_code_lines(spark, sf_dir) -> DataFrame:
    good = js(type=F.col("role"), sessionId=F.col("session"), uuid=F.concat(F.lit("u"), F.col("turn")), timestamp=F.col("created_at"), message=F.struct("role", block(F.col("text")).alias("content")))
    junk = js(type="progress", sessionId=F.col("session"), timestamp=F.col("created_at"))
    every = F.lit(True)
    return lines(spark, sf_dir, (0, every, good), (1, F.col("turn") == 1, good), (2, every, junk), (3, F.col("turn") == F.col("last"), F.lit('{"type": "user", "sess')))


def render_claude_code(spark, sf_dir) -> str:
    return put_lines(claude_code_lines(spark, sf_dir), scratch(spark, "claude-code"))


@query("import_claude_code", expected())
def import_claude_code(spark, sf_dir):
    return shown(claude_code.read(spark, render_claude_code(spark, sf_dir)))


def render_codex(spark, sf_dir) -> str:
    meta = js(type="session_meta", timestamp=F.col("created_at"), payload=F.struct(F.col("session").alias("session_id")))
    good = js(type=F.col("role"), timestamp=F.col("created_at"), id=F.concat(F.lit("u"), F.col("turn")), payload=F.struct(F.struct("role", block(F.col("text")).alias("content")).alias("message")))
    odd = js(type="unknown_event", timestamp=F.col("created_at"), payload=F.struct(F.lit("x").alias("note")))
    every = F.lit(True)
    return put_lines(lines(spark, sf_dir, (-1, F.col("turn") == 0, meta), (0, every, good), (1, F.col("turn") == 0, good), (2, every, odd), (5, F.col("turn") == F.col("last"), F.lit('{"cut'))), scratch(spark, "codex/sessions"), per_session=True)


@query("import_codex", expected())
def import_codex(spark, sf_dir):
    return shown(codex.read(spark, render_codex(spark, sf_dir)))


@query("title_sidecar", expected(title="CASE WHEN conv_id % 2 = 0 THEN 'Named ' || session ELSE CASE WHEN length({t}) > 72 THEN substr({t}, 1, 69) || '...' ELSE {t} END END".replace("{t}", "trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_min(text, turn)), '\\s+', ' ', 'g'))")))
def title_sidecar(spark, sf_dir):
    t = turns(spark, sf_dir).filter("turn = 0 and conv_id % 2 = 0")
    side = t.select("session", F.lit(0).alias("at"), js(session_id=F.col("session"), text="<environment_context> x").alias("value")).union(t.select("session", F.lit(1), js(id=F.col("session"), thread_name=F.concat(F.lit("Named  "), "session"))))
    titles = codex.sidecar_titles(base.text_lines(spark, put_lines(side, scratch(spark, "sidecar"))))
    return shown(codex.read(spark, render_codex(spark, sf_dir), titles))


SESSIONS_A_FILE = 500


def render_claude_web(spark, sf_dir) -> str:
    t = turns(spark, sf_dir)
    said = F.struct("turn", F.struct(F.concat(F.lit("u"), F.col("turn")).alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.lit("not shown").alias("text"), F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hidden sentinel").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.col("created_at").alias("created_at")).alias("m"))
    # Some SESSIONS_A_FILE sessions in each export file, whatever the table's size.
    n_files = max(4, t.select("session").distinct().count() // SESSIONS_A_FILE)
    place = F.pmod(F.hash("session"), F.lit(n_files))
    one = t.groupBy("session", place.alias("file")).agg(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["m"]).alias("chat_messages"))
    one = one.union(t.filter("turn = 0 and conv_id % 9 = 0").select(F.concat(F.lit("empty-"), "session"), place, F.array(said["m"]).alias("x")).withColumn("x", F.filter("x", lambda m: F.lit(False))))
    body = one.select("file", js(uuid=F.col("session"), chat_messages=F.col("chat_messages")).alias("c")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("c")), ","), F.lit("]")).alias("value"))
    path = scratch(spark, "claude-web")
    body.repartition("file").select("file", "value").write.partitionBy("file").text(path)
    return path


@query("import_claude_web", expected())
def import_claude_web(spark, sf_dir):
    return shown(claude_web.read(spark, render_claude_web(spark, sf_dir)))


#: User and assistant turns as request and response pairs: a pair starts at each user turn.
PAIR_SQL = """p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS pair FROM m WHERE role IN ('user', 'assistant')),
q AS (SELECT conv_id, session, pair, max(CASE WHEN role = 'user' THEN text END) AS u, max(CASE WHEN role = 'user' THEN created_at END) AS uc, arg_min(text, turn) FILTER (role = 'assistant') AS a, min(created_at) FILTER (role = 'assistant') AS ac FROM p WHERE pair > 0 GROUP BY ALL),
s AS (SELECT session, pair * 2 AS o, 'user' AS role, uc AS created_at, u AS text FROM q UNION ALL SELECT session, pair * 2 + 1, 'assistant', ac, a FROM q WHERE a IS NOT NULL)"""


def render_copilot(spark, sf_dir) -> str:
    t = turns(spark, sf_dir).filter("role in ('user', 'assistant')")
    t = t.withColumn("pair", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("session").orderBy("turn"))).filter("pair > 0")
    mine, theirs = F.col("role") == "user", F.col("role") == "assistant"
    pairs = t.groupBy("session", "pair").agg(F.max(F.when(mine, F.col("text"))).alias("u"), F.max(F.when(mine, F.col("created_at"))).alias("uc"), F.min_by("text", F.when(theirs, F.col("turn"))).alias("a"), F.min(F.when(theirs, F.col("created_at"))).alias("ac"))
    request = F.struct("pair", F.struct(F.concat(F.lit("r"), F.col("pair")).alias("requestId"), F.struct(F.col("u").alias("text")).alias("message"), F.col("uc").alias("timestamp"), F.when(F.col("a").isNotNull(), F.array(F.struct(F.col("a").alias("value")))).alias("response"), F.col("ac").alias("responseDate")).alias("r"))
    whole = pairs.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(request)), lambda s: s["r"]).alias("requests"))
    snap = lambda reqs: F.to_json(F.struct(F.lit(0).alias("kind"), F.struct(F.col("session").alias("sessionId"), reqs.alias("requests")).alias("v")))
    rows = whole.select("session", F.lit(0).alias("at"), snap(F.slice("requests", 1, 1)).alias("value")).union(whole.select("session", F.lit(1), snap(F.col("requests")))).union(whole.select("session", F.lit(2), F.lit('{"kind": 1, "v": "x"}')))
    return put_lines(rows, scratch(spark, "chatSessions"), per_session=True)


@query("import_copilot", rf"WITH {STORE_SQL}, {PAIR_SQL}, f AS (SELECT session, arg_min(trim(regexp_replace(text, '\s+', ' ', 'g')), o) AS t, arg_min(created_at, o) AS started_at, arg_max(created_at, o) AS updated_at FROM s GROUP BY 1) SELECT session, CASE WHEN length(t) > 72 THEN substr(t, 1, 69) || '...' ELSE t END AS title, started_at, updated_at, CAST(row_number() OVER (PARTITION BY session ORDER BY o) AS INT) AS n, role, created_at, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM s JOIN f USING (session)")
def import_copilot(spark, sf_dir):
    return shown(copilot.read(spark, render_copilot(spark, sf_dir)))


def relational(spark, sf_dir) -> dict[str, DataFrame]:
    t = turns(spark, sf_dir)
    mid = F.concat("session", F.lit("/"), F.col("turn").cast("string"))
    content = F.when(F.col("turn") % 2 == 0, F.col("text"))
    halves = F.array(F.struct(F.lit(1).alias("k"), F.element_at(F.split("text", " ", 2), 1).alias("t")), F.struct(F.lit(2).alias("k"), F.get(F.split("text", " ", 2), 1).alias("t")))
    return {
        "session": t.groupBy("session", "conv_id").agg(F.max("created_at").alias("updated_at")).select(F.col("session").alias("id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("w"), (F.col("conv_id") % 7).cast("string")).alias("workspace_id"), "updated_at"),
        "message": t.select(mid.alias("id"), F.col("session").alias("session_id"), "role", "created_at", content.alias("content"), F.col("turn").alias("ord")),
        "part": t.filter("turn % 2 = 1").select(mid.alias("message_id"), F.explode(halves).alias("h")).select("message_id", F.col("h.k").alias("ord"), F.col("h.t").alias("text")),
        "workspace": spark.range(7).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("/work/"), F.col("id").cast("string")).alias("directory")),
    }


@query("import_opencode", rf"WITH {STORE_SQL}, k AS (SELECT conv_id, session, turn, role, created_at, CASE WHEN turn % 2 = 0 THEN text ELSE regexp_replace(CASE WHEN instr(text, ' ') > 0 THEN substr(text, 1, instr(text, ' ') - 1) || chr(10) || substr(text, instr(text, ' ') + 1) ELSE text END, '^\s+|\s+$', '', 'g') END AS text FROM m WHERE regexp_matches(text, '\S')), h AS (SELECT session, conv_id, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\s+', ' ', 'g')) AS t, arg_min(created_at, turn) AS started_at, max(created_at) AS updated_at FROM k GROUP BY 1, 2) SELECT session, CASE WHEN t = '' THEN 'OpenCode ' || session WHEN length(t) > 72 THEN substr(t, 1, 69) || '...' ELSE t END AS title, started_at, updated_at, '/work/' || (h.conv_id % 7) AS workspace, CAST(row_number() OVER (PARTITION BY session ORDER BY turn) AS INT) AS n, role, created_at, text FROM k JOIN h USING (session)")
def import_opencode(spark, sf_dir):
    b = opencode.from_relational(spark, relational(spark, sf_dir))
    extra = b.conversations.select(F.col("upstream_id").alias("session"), F.col("metadata")["workspaceDirectory"].alias("workspace"))
    return shown(b).join(extra, "session")


def render_cursor(spark, sf_dir) -> str:
    said = js(role=F.col("role"), message=F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("sentinel").alias("text"))).alias("content")))
    status = js(type="status", state="running")
    root = scratch(spark, "cursor")
    every = F.col("role").isin("user", "assistant")
    put_lines(lines(spark, sf_dir, (0, every, said), (1, F.lit(True), status)), f"{root}/one/agent-transcripts", per_session=True)
    # A second, shorter copy of some, and copies that are broken inside.
    put_lines(lines(spark, sf_dir, (0, every & (F.col("turn") < 2) & (F.col("conv_id") % 3 == 0), said)), f"{root}/two/agent-transcripts", per_session=True)
    put_lines(lines(spark, sf_dir, (0, every & (F.col("conv_id") % 5 == 0), said), (1, (F.col("turn") == 0) & (F.col("conv_id") % 5 == 0), F.lit('{"role": "us'))), f"{root}/three/agent-transcripts", per_session=True)
    return root


@query("import_cursor", rf"WITH {STORE_SQL}, k AS (SELECT session, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM m WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S')), h AS (SELECT session, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\s+', ' ', 'g')) AS t FROM k GROUP BY 1) SELECT session, CASE WHEN t = '' THEN 'Cursor session ' || session WHEN length(t) > 72 THEN substr(t, 1, 69) || '...' ELSE t END AS title, CAST(row_number() OVER (PARTITION BY session ORDER BY turn) AS INT) AS n, role, text FROM k JOIN h USING (session)")
def import_cursor(spark, sf_dir):
    return shown(cursor.read(spark, render_cursor(spark, sf_dir))).drop("started_at", "updated_at", "created_at")


def render_pi(spark, sf_dir) -> str:
    """A tree whose every fourth turn has a sibling that was left."""
    head = js(type="session", version=3, id=F.col("session"), timestamp=F.col("created_at"), cwd="/work")
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("e"), (F.col("turn") - 1).cast("string")))
    entry = lambda id_, text: F.concat(F.lit('{"type":"message","id":"'), id_, F.lit('","parentId":'), F.coalesce(F.concat(F.lit('"'), parent, F.lit('"')), F.lit("null")), F.lit(',"timestamp":"'), F.col("created_at"), F.lit('","message":'), F.to_json(F.struct("role", block(text).alias("content"))), F.lit("}"))
    own = F.concat(F.lit("e"), F.col("turn").cast("string"))
    every = F.lit(True)
    return put_lines(lines(spark, sf_dir, (-5, F.col("turn") == 0, head), (0, F.col("turn") % 4 == 1, entry(F.concat(own, F.lit("x")), F.lit("left branch sentinel"))), (1, every, entry(own, F.col("text")))), scratch(spark, "pi/sessions"), per_session=True)


@query("import_pi", expected("role IN ('user', 'assistant')", start="strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id), '%Y-%m-%dT%H:%M:%S.000Z')"))
def import_pi(spark, sf_dir):
    return shown(pi.read(spark, render_pi(spark, sf_dir)))


def render_grok(spark, sf_dir, summaries: bool = True) -> str:
    """Texts in two chunks, thoughts between, and a prompt that is rewound; summaries only where they are read, since each is a file."""
    half = F.floor(F.length("text") / 2).cast("int")
    kind = F.when(F.col("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("session").orderBy("turn"))
    t = turns(spark, sf_dir).filter("role in ('user', 'assistant')").withColumn("prompt", users - 1).withColumn("prev", F.lag("role").over(Window.partitionBy("session").orderBy("turn"))).withColumn("last", F.max("turn").over(Window.partitionBy("session")))
    seconds = F.unix_seconds(F.col("created_at").cast("timestamp"))
    mark = F.when(F.col("role") == "user", F.struct(F.col("prompt").alias("promptIndex")))
    update = lambda text, k=kind, m=mark: F.to_json(F.struct(F.lit("session/update").alias("method"), seconds.alias("timestamp"), F.struct(F.struct(k.alias("sessionUpdate"), F.struct(F.lit("text").alias("type"), text.alias("text")).alias("content"), m.alias("_meta")).alias("update")).alias("params")))
    extra = F.to_json(F.struct(F.lit("session/update").alias("method"), F.struct(F.struct(F.lit("tool_call").alias("sessionUpdate"), F.lit("sentinel").alias("title")).alias("update")).alias("params")))
    lost = update(F.lit("rewound sentinel"), F.lit("user_message_chunk"), F.struct((users + 0).alias("promptIndex")))
    rewind = F.to_json(F.struct(F.lit("_x.ai/session/update").alias("method"), F.struct(F.struct(F.lit("rewind_marker").alias("sessionUpdate"), F.col("gone").alias("target_prompt_index")).alias("update")).alias("params")))
    t = t.withColumn("gone", users)
    parts = [(-1, F.lit(True), extra), (0, F.lit(True), update(F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))"))), (1, F.lit(True), update(F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"))), (2, F.col("turn") == F.col("last"), lost), (3, F.col("turn") == F.col("last"), rewind)]
    rows = None
    for offset, keep, value in parts:
        part = t.withColumn("value", value).filter(keep).select("session", (F.col("turn") * 10 + offset).alias("at"), "value")
        rows = part if rows is None else rows.union(part)
    root = scratch(spark, "grok")
    put_lines(rows, f"{root}/updates", per_session=True)
    if not summaries:
        return root
    summary = turns(spark, sf_dir).filter("turn = 0").select("session", F.lit(0).alias("at"), js(info=F.struct(F.col("session").alias("id")), current_model_id="model-x").alias("value"))
    put_lines(summary, f"{root}/summary", per_session=True)
    return root


@query("import_grok", expected("role IN ('user', 'assistant')"))
def import_grok(spark, sf_dir):
    root = render_grok(spark, sf_dir)
    return shown(grok_build.read(spark, f"{root}/updates", f"{root}/summary"))


def render_kimi(spark, sf_dir) -> str:
    """Prompts that the context repeats, agent steps in parts, a prompt that is undone, tool traffic."""
    time = F.col("ms")
    user, agent = F.col("role") == "user", F.col("role") == "assistant"
    prompt = js(type="turn.prompt", time=time, input=block(F.col("text")))
    append = js(type="context.append_message", time=time, message=F.struct(F.lit("user").alias("role"), block(F.col("text")).alias("content"), F.concat(F.lit("u"), F.col("turn")).alias("id")))
    step = lambda kind, **more: js(type="context.append_loop_event", time=time, event=F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in more.items()]))
    sid = F.concat(F.lit("s"), F.col("turn").cast("string"))
    tool = step("tool.result", uuid=sid, output=F.lit("sentinel " * 20))
    lost = js(type="turn.prompt", time=time, input=block(F.lit("undone sentinel")))
    undo = js(type="context.undo", count=1)
    end = F.col("turn") == F.col("last")
    root = scratch(spark, "kimi")
    rows = lines(spark, sf_dir, (0, user, prompt), (1, user, append), (2, agent, step("step.begin", uuid=sid)), (3, agent, step("content.part", stepUuid=sid, part=F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))), (4, F.lit(True), tool), (5, agent, step("step.end", uuid=sid)), (7, end, lost), (8, end, undo))
    put_files(spark, rows.select("session", "at", F.lit("wire").alias("log"), "value"), root, "session", "log")
    return root


@query("import_kimi", expected("role IN ('user', 'assistant')"))
def import_kimi(spark, sf_dir):
    return shown(kimi_code.read(spark, render_kimi(spark, sf_dir)))
