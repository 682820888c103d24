"""Update logs of message chunks, with rewinds, beside a summary object per session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.text import session_title, trimmed
from scrollmill.functions.times import EPOCH, seconds_or_millis
from scrollmill.operators.batch import Batch
from scrollmill.sources import base as S

ID, LABEL = "grok-build", "Grok Build"
DIR = r"^(.*)/[^/]+$"


def replay(events: list[tuple]) -> list[tuple]:
    """(line, n, role, text) of the messages that stand after all chunks and rewinds.

    An event is (line, n, op, text, prompt): op is user, agent, thought, rewind or break; prompt is a
    chunk's prompt index or a rewind's target (None where it has none). Chunks of one role, and of one prompt
    for users, run together until something else comes; a thought does not end an agent's run.
    A rewind keeps what came before its prompt; one past the last prompt keeps all; one without a valid target only ends the run.
    Once a kept user chunk has had an index, user chunks without one are echoes and are dropped.
    """
    done: list[dict] = []
    running: dict | None = None
    indexed = False
    for line, n, op, text, prompt in events:
        if op == "thought":
            running = running if running and running["role"] == "agent" else None
        elif op == "rewind":
            running = None
            if prompt is None:
                continue
            starts = [k for k, m in enumerate(done) if m["role"] == "user"]
            if prompt < len(starts):
                del done[starts[prompt] :]
            indexed = any(m["role"] == "user" and m["prompt"] is not None for m in done)
        elif op == "break" or (op == "user" and indexed and prompt is None):
            running = None
        else:
            indexed = indexed or (op == "user" and prompt is not None)
            if running is None or running["role"] != op or (op == "user" and running["prompt"] != prompt):
                running = {"line": line, "n": n, "role": op, "prompt": prompt, "parts": []}
                done.append(running)
            running["parts"].append(text)
    return [(m["line"], m["n"], m["role"], "".join(m["parts"]).strip()) for m in done]


def reduce_session(key, events: list[tuple]) -> list[tuple]:
    return [(key, *m) for m in replay(events) if m[3]]


def events(records):
    """(dir, line, n, op, text, prompt, t_number, t_text): updates as events; payloads of other kinds are dropped here."""
    update = F.coalesce(V.get("v", "$.params.update"), V.get("v", "$.update"))
    listed = F.when(V.kind(update).startswith("ARRAY"), V.items(update)).otherwise(F.array(update))
    rows = records.select(F.regexp_extract("path", DIR, 1).alias("dir"), "line", F.coalesce(V.string("v", "$.method"), F.lit("session/update")).alias("method"), V.number("v", "$.timestamp").alias("t_number"), V.string("v", "$.timestamp").alias("t_text"), F.posexplode_outer(listed).alias("n", "u"))
    kind = F.coalesce(V.string("u", "$.sessionUpdate"), F.lit(""))
    chunk = F.when(kind == "user_message_chunk", "user").when(kind == "agent_message_chunk", "agent")
    display = F.when(V.kind(V.get("u", "$.content._meta.displayText")) == "STRING", F.try_variant_get("u", "$.content._meta.displayText", "string"))
    text = F.coalesce(display, F.when(V.kind(V.get("u", "$.content.text")) == "STRING", F.try_variant_get("u", "$.content.text", "string")))
    whole = lambda p: F.when((V.number("u", p) >= 0) & (V.number("u", p) == F.floor(V.number("u", p))), V.number("u", p).cast("long"))
    hidden = (kind == "user_message_chunk") & (V.string("u", "$.content._meta.bash_command").isNotNull() | F.coalesce(F.try_variant_get("u", "$._meta.hostTurn", "boolean"), F.lit(False)))
    usable = (F.col("method") == "session/update") & chunk.isNotNull() & F.coalesce(V.string("u", "$.content.type") == "text", F.lit(False)) & ~hidden & F.coalesce(trimmed(text) != "", F.lit(False))
    op = F.when((F.col("method") == "_x.ai/session/update") & (kind == "rewind_marker"), "rewind").when((F.col("method") == "session/update") & (kind == "agent_thought_chunk"), "thought").when(usable, chunk).otherwise("break")
    out = rows.select("dir", "line", F.coalesce("n", F.lit(0)).alias("n"), op.alias("op"), F.when(usable, text).alias("text"), F.when(op == "rewind", whole("$.target_prompt_index")).when(kind == "user_message_chunk", whole("$._meta.promptIndex")).alias("prompt"), "t_number", "t_text")
    return out


#: Lines of a file that are looked at to tell an update log.
SNIFF_LINES = 1000


def sniffed(lines: DataFrame) -> DataFrame:
    """(path) of the files whose first lines look like an update log."""
    v = F.col("value")
    marks = {"update": r'"sessionUpdate"\s*:', "method": r'"method"\s*:\s*"(_x\.ai/)?session/update"', "session": r'"sessionId"\s*:', "body": r'"update"\s*:'}
    held = lines.filter(F.col("line") <= SNIFF_LINES).groupBy("path").agg(*[F.bool_or(v.rlike(p)).alias(n) for n, p in marks.items()])
    return held.filter("update and (method or (session and body))").select("path")


def cwd_files(parents: DataFrame) -> DataFrame:
    """(parent, cwd) from the `.cwd` files of folders; Spark's readers skip such names, so tasks open them one by one."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            found = []
            for parent in batch.column(0).to_pylist():
                try:
                    store, path = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", parent) if parent.startswith("file:") else parent)
                    with store.open_input_stream(f"{path}/.cwd") as source:
                        found.append((parent, source.read(65536).decode(errors="replace").strip()))
                except (OSError, pa.ArrowInvalid):  # no such file, or a store that tasks cannot open
                    continue
            found = [f for f in found if f[1]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["parent", "cwd"])

    return parents.select("parent").mapInArrow(read, "parent string, cwd string")


@S.register_source(ID, LABEL, "stable", r"/updates\.jsonl$|/updates/.*part-[^/]*$", by_file=False)
def read(spark: SparkSession, root: str, summaries: str | None = None, workspaces=None) -> Batch:
    """Update logs under `root`; summary objects under `summaries` (default: the same), joined by session folder.

    `workspaces` is an optional sidecar (parent, cwd): the workspace of sessions whose summary names none; by default the
    `.cwd` files beside the session folders. Files that do not look like update logs in their first lines are left out.
    """
    S.tolerant(spark)
    lines = S.text_lines(spark, root, r"updates\.jsonl$|updates/.*part-")
    records, bad = S.read_jsonl(lines.join(sniffed(lines), "path", "left_semi"), ID, tail="grok_build")
    found = events(records)
    # Folder names join both files: <session>/updates... and <session>/summary...
    key = F.regexp_extract("dir", r"session=([^/]+)", 1)
    found = found.withColumn("dir", F.coalesce(F.nullif(key, F.lit("")), F.col("dir")))
    kept = S.per_session(found.select("dir", "line", "n", "op", "text", "prompt"), ["line", "n"], reduce_session, "dir string, line int, n int, role string, text string")
    objects, unread = S.read_objects(spark, summaries or root, r"summary\.json$|summary/.*part-", ID)
    where = F.regexp_extract("path", DIR, 1)
    meta = objects.select(F.coalesce(F.nullif(F.regexp_extract("path", r"session=([^/]+)", 1), F.lit("")), where).alias("dir"), F.col("v").alias("s"))
    hidden = F.coalesce(F.try_variant_get("s", "$.hidden", "boolean"), V.string("s", "$.session_kind").startswith("subagent"), F.lit(False))
    shown = records.select(F.coalesce(F.nullif(F.regexp_extract("path", r"session=([^/]+)", 1), F.lit("")), where).alias("dir")).distinct().join(meta, "dir", "left").filter(~hidden)
    time = lambda v: F.nullif(seconds_or_millis(V.number(v), V.string(v), "-"), F.lit("-"))
    timed = kept.join(found.select("dir", "line", "n", "t_number", "t_text"), ["dir", "line", "n"]).join(shown.select("dir", F.coalesce(time(V.get("s", "$.created_at")), F.lit(EPOCH)).alias("fallback"), V.string("s", "$.current_model_id").alias("model")), "dir")
    at = F.coalesce(F.nullif(seconds_or_millis("t_number", "t_text", "-"), F.lit("-")), F.col("fallback"))
    role = F.when(F.col("role") == "agent", "assistant").otherwise("user")
    messages = timed.select(F.col("dir").alias("conv_key"), (F.col("line") * 100_000 + F.col("n")).cast("long").alias("ord"), F.concat(F.lit("L"), F.col("line").cast("string"), F.lit("-"), (F.col("n") + 1).cast("string")).alias("upstream_id"), role.alias("role"), at.alias("created_at"), "text", F.when(role == "assistant", F.col("model")).alias("model_id"))
    messages = S.settle(messages)
    whole, none = S.split_empty(shown.withColumn("conv_key", F.col("dir")), messages, ID, "grok_build_no_messages", "dir")
    done = whole.join(S.sessions(messages), "conv_key").withColumn("upstream_id", F.coalesce(V.string("s", "$.info.id"), F.element_at(F.split("dir", "/"), -1)))
    if workspaces is None:
        workspaces = cwd_files(done.select(S.parent("dir").alias("parent")).filter("parent like '%/%'").distinct())
    done = done.join(workspaces.select(F.col("parent").alias("_p"), "cwd"), S.parent("dir") == F.col("_p"), "left")
    done = done.withColumn("generated", V.string("s", "$.generated_title")).withColumn("summary", V.string("s", "$.session_summary"))
    conversations = done.select("conv_key", "upstream_id", S.best_title(session_title(F.lit(LABEL), "upstream_id"), "generated", "summary").alias("title"), F.coalesce(time(V.get("s", "$.created_at")), F.col("started")).alias("started_at"), F.coalesce(time(V.get("s", "$.updated_at")), F.col("updated")).alias("updated_at"), S.metadata(sourcePath=F.col("dir"), format="grok-acp-updates-jsonl", workspaceDirectory=F.coalesce(V.string("s", "$.info.cwd"), F.col("cwd")), currentModelId=V.string("s", "$.current_model_id"), sessionKind=V.string("s", "$.session_kind")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [bad, unread, none])
