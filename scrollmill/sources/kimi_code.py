"""Wire logs of prompts, context messages and agent steps, with undo, beside a state object per session."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.text import session_title
from scrollmill.functions.times import EPOCH
from scrollmill.operators.batch import Batch, cut
from scrollmill.sources import base as S

ID, LABEL = "kimi-code", "Kimi Code"
#: The session's folder: above agents/main/, or above a partition folder log=wire.
DIR = r"^(.*)/(?:agents/main|log=wire)/[^/]+$"
#: Lines of other types are dropped before they are parsed: tool traffic is nearly all of a log.
KEPT = r'"type"\s*:\s*"(turn\.prompt|turn\.steer|context\.append_message|step\.begin|content\.part|step\.end|llm\.request|context\.undo|context\.clear|context\.apply_compaction)"'


def replay(events: DataFrame) -> DataFrame:
    """The messages of all sessions that stand at their ends, of (dir, line, op, text, time, id, count, model) with one row a line.

    prompt: a user's input, which a later user message of equal text completes (time and id) instead of repeating it, first come first served.
    step, part, end: an agent's step and what is added to it by its id. model: names the running step's model. undo: takes back from the
    end until `count` user messages are gone, never past the last clear. clear: sets that floor. An undo or a clear forgets waiting prompts and open steps.

    No event is replayed: each is placed by running sums and least values over its session. The windows see no text and share
    one shuffle; texts meet by message.
    """
    own = lambda *keys: Window.partitionBy("dir", *keys).orderBy("line")
    back = lambda *keys: Window.partitionBy("dir", *keys).orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    till = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda *ops: F.col("op").isin(*ops)
    one = lambda test: F.when(test, 1).otherwise(0)
    lowest = lambda c, w: F.least(F.lit(0), F.coalesce(F.min(c).over(w), F.lit(0)))

    rows = events.select("dir", "line", "op", F.when(is_("prompt", "user"), F.sha2("text", 256)).alias("said"), "time", F.col("id").alias("name"), F.when(is_("step", "part", "end"), F.col("id")).alias("step"), "count", F.when(F.col("model") != "", F.col("model")).alias("model"))
    rows = rows.repartition("dir")
    # Prompts and steps wait no longer than to the next undo or clear; what one takes back starts at the last clear.
    rows = rows.withColumns({"part": F.sum(one(is_("undo", "clear"))).over(till(own())), "era": F.sum(one(is_("clear"))).over(till(own()))})
    # A user message takes a waiting prompt unless it brings the balance of both to a new low; the n-th that takes one takes the n-th.
    same = own("part", "said")
    rows = rows.withColumn("balance", F.sum(one(is_("prompt")) - one(is_("user"))).over(till(same)))
    rows = rows.withColumn("takes", is_("user") & (F.col("balance") >= lowest("balance", before(same))))
    rows = rows.withColumn("nth", F.when(is_("prompt"), F.sum(one(is_("prompt"))).over(till(same))).when(F.col("takes"), F.sum(one(F.col("takes"))).over(till(same))))
    prompt = F.min(F.when(is_("prompt"), F.col("line"))).over(Window.partitionBy("dir", "part", "said", "nth"))
    # A step is open from its start to its end; the last one that started is the running one while it is open.
    rows = rows.withColumns({"ended": F.last(F.when(is_("end"), F.col("line")), True).over(back("part", "step")), "prompt": prompt, "opened": F.last(F.when(is_("step", "end"), F.struct("line", "op")), True).over(till(own("part", "step")))})
    rows = rows.withColumn("running", F.last(F.when(is_("step", "undo", "clear"), F.struct("line", "op", "ended")), True).over(till(own())))
    entry = (
        F.when(F.col("takes"), F.col("prompt"))
        .when(is_("prompt", "user", "assistant", "step"), F.col("line"))
        .when(is_("part") & (F.col("opened.op") == "step"), F.col("opened.line"))
        .when(is_("model") & (F.col("running.op") == "step") & (F.col("running.ended").isNull() | (F.col("running.ended") > F.col("line"))), F.col("running.line"))
    )
    rows = rows.withColumn("entry", entry)
    # User messages stand as on a stack: an undo leaves so many, or takes all back to the floor; what is higher than a later undo leaves is gone.
    back_by = F.when(is_("undo") & (F.col("count") > 0), F.least(F.ceil("count"), F.lit(10**9)).cast("long")).otherwise(0)
    rows = rows.withColumn("level", F.sum(one(is_("prompt") | (is_("user") & ~F.col("takes"))) - back_by).over(till(own("era"))))
    rows = rows.withColumn("low", lowest("level", before(own("era"))))
    rows = rows.withColumn("height", F.col("level") - F.least("level", "low"))
    left = F.when(back_by > 0, F.when(F.col("level") < F.col("low"), -1).otherwise(F.col("height")))
    rows = rows.withColumn("left", left).withColumn("least", F.min("left").over(back("era")))
    rows = rows.withColumn("stands", (F.col("entry") == F.col("line")) & (F.col("least").isNull() | (F.col("least") >= F.col("height"))))
    rows = rows.withColumn("ord", F.sum(one(F.col("stands"))).over(till(own())) - 1)

    of = rows.filter("entry is not null").select("dir", "line", "entry", "op", "takes", "stands", "ord", "time", "name", "model")
    head = lambda c: F.max(F.when(F.col("entry") == F.col("line"), F.col(c)))
    taken = lambda c: F.max(F.when(F.col("takes"), F.col(c)))
    told = of.groupBy("dir", "entry").agg(
        head("stands").alias("stands"), head("ord").alias("ord"), head("op").alias("head"),
        F.coalesce(taken("time"), head("time")).alias("time"),
        F.coalesce(F.nullif(taken("name"), F.lit("")), F.max(F.when((F.col("entry") == F.col("line")) & ~is_("prompt"), F.col("name")))).alias("upstream_id"),
        F.max_by("model", F.when(is_("model") & F.col("model").isNotNull(), F.col("line"))).alias("model_id"),
        F.array_sort(F.collect_list(F.when(is_("prompt", "user", "assistant", "part") & ~F.col("takes"), F.col("line")))).alias("lines"),
    ).filter("stands")
    attributes = ("ord", "head", "time", "upstream_id", "model_id")
    parts = told.select("dir", "entry", *attributes, F.explode("lines").alias("line")).join(events.filter("text is not null").select("dir", "line", "text"), ["dir", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]), "\n").alias("text")
    whole = parts.groupBy("dir", "entry").agg(*[F.first(c).alias(c) for c in attributes], text)
    role = F.when(F.col("head").isin("prompt", "user"), "user").otherwise("assistant").alias("role")
    return whole.select("dir", "ord", "upstream_id", role, "time", "text", "model_id")


SPOKEN = "dir string, line long, op string, text string, time string, id string, count double, model string"


def with_texts(frames):
    """What a user or an agent said in each event, from JSON texts; events that say nothing and parts of steps without a name are dropped."""

    def one(op, content, origin):
        if op not in ("prompt", "user", "assistant", "part"):
            return None
        content, origin = [json.loads(x) if x else None for x in (content, origin)]
        return asked(content, origin) if op in ("prompt", "user") else shown(content)

    for frame in frames:
        frame["text"] = pd.Series([one(*row) for row in zip(frame["op"], frame["content"], frame["origin"])], dtype=object, index=frame.index)
        nameless = frame["op"].isin(["step", "part", "end"]) & frame["id"].isna()
        yield frame[~nameless & (frame["text"] != "")][["dir", "line", "op", "text", "time", "id", "count", "model"]]


def spoken(found: DataFrame) -> DataFrame:
    """Events with their texts, written once: a replay looks at the texts apart."""
    return cut(found.mapInPandas(with_texts, SPOKEN), "events")


MARKS = {"image_url": "[image]", "audio_url": "[audio]", "video_url": "[video]"}


def shown(content) -> str:
    """Text of a string, a part or an array of parts; media as marks, other kinds dropped."""
    if isinstance(content, str):
        return content.strip()
    texts = []
    for p in content if isinstance(content, list) else [content]:
        kind = p.get("type") if isinstance(p, dict) else False
        if kind in MARKS:
            texts.append(MARKS[kind])
        elif kind in (None, "text") and isinstance(p.get("text"), str) and p["text"].strip():
            texts.append(p["text"])
    return "\n".join(texts).strip()


def asked(content, origin) -> str:
    """What a user saw: commands by their names, skills that came along cut, reminders and other origins dropped."""
    origin = origin if isinstance(origin, dict) else {}
    kind = origin.get("kind")
    if kind in ("skill_activation", "plugin_command"):
        keys = ("skillName",) if kind == "skill_activation" else ("pluginId", "commandName")
        name, rest = [origin.get(k) for k in keys], origin.get("skillArgs" if len(keys) == 1 else "commandArgs")
        whole = all(isinstance(n, str) and n.strip() for n in name) and origin.get("trigger") == "user-slash"
        return f"/{':'.join(name)} {rest.strip() if isinstance(rest, str) else ''}".strip() if whole else ""
    if kind not in (None, "user"):
        return ""
    if kind == "user" and isinstance(content, list):
        content = content[len(origin.get("skillActivations") or []) :]
    text = shown(content)
    return "" if re.fullmatch(r"(?is)<system-reminder>.*</system-reminder>", text) else text


def events(records):
    """(dir, line, op, content, origin, time, id, count, model): only what the replay needs.

    Content and origin stay JSON text; tool payloads never leave this step.
    """
    loop = F.col("kind") == "context.append_loop_event"
    op = (
        F.when(F.col("kind").isin("turn.prompt", "turn.steer"), "prompt")
        .when((F.col("kind") == "context.append_message") & F.col("said").isin("user", "assistant"), F.col("said"))
        .when(loop & (F.col("event") == "step.begin"), "step")
        .when(loop & (F.col("event") == "content.part"), "part")
        .when(loop & (F.col("event") == "step.end"), "end")
        .when(F.col("kind") == "llm.request", "model")
        .when(F.col("kind") == "context.undo", "undo")
        .when(F.col("kind").isin("context.clear", "context.apply_compaction"), "clear")
    )
    # Lines of several files of one session stay apart.
    place = F.col("line").cast("long") * (1 << 20) + F.pmod(F.xxhash64("path"), F.lit(1 << 20))
    rows = records.select(F.regexp_extract("path", DIR, 1).alias("dir"), place.alias("line"), "v", V.string("v", "$.type").alias("kind"), V.string("v", "$.event.type").alias("event"), V.string("v", "$.message.role").alias("said"))
    rows = rows.withColumn("op", op).filter("op is not null")
    is_ = lambda *ops: F.col("op").isin(*ops)
    content = F.when(is_("prompt"), V.get("v", "$.input")).when(is_("part"), V.get("v", "$.event.part")).otherwise(V.get("v", "$.message.content"))
    origin = F.when(is_("prompt"), V.get("v", "$.origin")).when(is_("user"), V.get("v", "$.message.origin"))
    id_ = F.when(is_("step", "end"), V.string("v", "$.event.uuid")).when(is_("part"), V.string("v", "$.event.stepUuid")).otherwise(V.string("v", "$.message.id"))
    time = F.nullif(S.json_date(V.get("v", "$.time"), F.lit("")), F.lit(""))
    return rows.select("dir", "line", "op", F.to_json(content).alias("content"), F.to_json(origin).alias("origin"), time.alias("time"), id_.alias("id"), F.coalesce(V.number("v", "$.count"), F.lit(0.0)).alias("count"), V.string("v", "$.modelAlias", "$.model").alias("model"))


@S.register_source(ID, LABEL, "stable", r"/agents/main/wire\.jsonl$|/log=wire/[^/]*$", by_file=False)
def read(spark: SparkSession, root: str, states: str | None = None) -> Batch:
    """Wire logs of main agents under `root`, state objects under `states` (default: the same), joined by session folder."""
    S.tolerant(spark)
    lines = S.text_lines(spark, root, DIR)
    # A bad line must stay visible; of good ones only the kinds that matter are parsed.
    some = lines.filter(F.col("value").rlike(KEPT) | ~F.col("value").rlike(r"\}\s*$"))
    records, bad = S.read_jsonl(some, ID, tail="kimi_code")
    found = events(records)
    session = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"session=([^/]+)", 1), F.lit("")), F.regexp_extract(p, r"([^/]+)/?$", 1))
    found = found.withColumn("dir", session("dir"))
    kept = replay(spoken(found))
    objects, unread = S.read_objects(spark, states or root, r"state\.json$|state/.*part-", ID)
    meta = objects.select(session(S.parent("path")).alias("dir"), F.col("v").alias("s"))
    whole = S.log_files(spark, root, DIR).select(session(F.regexp_extract("path", DIR, 1)).alias("dir")).distinct().join(meta, "dir", "left").withColumn("conv_key", F.col("dir"))
    created = F.coalesce(F.nullif(S.json_date(V.get("s", "$.createdAt"), F.lit("")), F.lit("")), F.nullif(S.json_date(V.get("s", "$.updatedAt"), F.lit("")), F.lit("")), F.lit(EPOCH))
    messages = S.dedup(kept.join(whole.select("dir", created.alias("fallback")), "dir").select(F.col("dir").alias("conv_key"), "ord", "upstream_id", "role", F.coalesce("time", "fallback").alias("created_at"), "text", "model_id"))
    held, none = S.split_empty(whole, messages, ID, "kimi_code_no_messages", "dir")
    done = held.join(S.sessions(messages), "conv_key").withColumn("upstream_id", F.coalesce(V.string("s", "$.id"), F.col("dir"))).withColumn("state_title", V.string("s", "$.title"))
    state = lambda p: F.nullif(S.json_date(V.get("s", p), F.lit("")), F.lit(""))
    conversations = done.select("conv_key", "upstream_id", S.best_title(session_title(F.lit(LABEL), "upstream_id"), "state_title").alias("title"), F.coalesce(state("$.createdAt"), F.col("started")).alias("started_at"), F.coalesce(state("$.updatedAt"), F.col("updated")).alias("updated_at"), S.metadata(sourcePath=F.col("dir"), format="wire-jsonl", workspaceDirectory=V.string("s", "$.cwd", "$.workDir"), archived=F.try_variant_get("s", "$.archived", "boolean"), forkedFrom=V.string("s", "$.forkedFrom")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [bad, unread, none])
