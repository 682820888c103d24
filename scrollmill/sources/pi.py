"""Session trees: entries point to their parents, and only the branch of the active leaf is kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.ids import file_stem
from scrollmill.functions.text import session_title, trimmed, without_files
from scrollmill.operators.batch import Batch
from scrollmill.sources import base as S

ID, LABEL = "pi", "Pi"
VERIFIED = 3


def walk_back(ids: list, parents: list, roots: list, leaf) -> list[int] | None:
    """Places of the entries from the root to `leaf` (an id), or None if the way is broken or runs in a circle."""
    at = {i: k for k, i in enumerate(ids)}
    way: list[int] = []
    while leaf in at:
        k = at[leaf]
        if len(way) > len(ids):
            return None
        way.append(k)
        if roots[k]:
            return way[::-1]
        leaf = parents[k]
    return None


ENTRY = ["line", "id", "parent", "root", "leaf", "target", "target_null"]


def active_branch(entries: pd.DataFrame) -> tuple[list[int], str]:
    """`branch_of` of a table with the columns ENTRY."""
    return branch_of([tuple(None if pd.isna(x) else x for x in row) for row in entries[ENTRY].itertuples(index=False)])


def branch_of(entries: list[tuple]) -> tuple[list[int], str]:
    """(lines of the active branch, "ok" or "invalid") of one session's entries in file order.

    An entry is (line, id, parent, root (the parent is null), leaf (a leaf record), target, target_null).
    The last entry with an id is the leaf unless a leaf record says another; one without a target empties the branch.
    """
    if not entries:
        return [], "ok"
    lines, ids, parents, roots, leaves, targets, nulls = map(list, zip(*entries))
    no_parent = any(p is None and not r for p, r in zip(parents, roots))
    odd_leaf = any(leaf and t is None and not n for leaf, t, n in zip(leaves, targets, nulls))
    if None in ids or no_parent or odd_leaf or len(set(ids)) < len(ids):
        return [], "invalid"
    if leaves[-1] and nulls[-1]:
        return [], "ok"
    way = walk_back(ids, parents, roots, targets[-1] if leaves[-1] else ids[-1])
    return ([], "invalid") if way is None else ([lines[k] for k in way], "ok")


def resolve(path, entries: list[tuple]) -> list[tuple]:
    """One session, of (line, version, ...): a row per line of its branch, and a row with line 0 that holds the verdict."""
    tree = (entries[0][1] or 0) >= 2
    lines, verdict = branch_of([(e[0], *e[2:]) for e in entries]) if tree else ([e[0] for e in entries], "ok")
    return [(path, 0, 0, verdict), *((path, line, n + 1, verdict) for n, line in enumerate(lines))]


def branches(entries) -> DataFrame:
    """(path, line, place, verdict) of entries (path, version, ENTRY)."""
    rows = entries.select("path", "line", "version", *ENTRY[1:])
    return S.per_session(rows, ["line"], resolve, "path string, line int, place int, verdict string")


def visible(v, user: Column) -> Column:
    """Text parts and [image] marks; file bodies of a user's text are cut out."""
    shown = lambda t: F.nullif(trimmed(F.when(user, without_files(t)).otherwise(t)), F.lit(""))
    part = lambda p: F.when(V.string(p, "$.type") == "image", F.lit("[image]")).when(V.string(p, "$.type") == "text", shown(V.string(p, "$.text")))
    many = F.array_join(F.filter(F.transform(V.items(v), part), lambda t: t.isNotNull()), "\n")
    return F.when(V.kind(v) == "STRING", shown(F.try_variant_get(v, "$", "string"))).otherwise(F.nullif(trimmed(many), F.lit("")))


@S.register_source(ID, LABEL, "stable", r"/sessions/.*(\.jsonl|/part-[^/]*)$")
def read(spark: SparkSession, root: str) -> Batch:
    S.tolerant(spark)
    records, bad = S.read_jsonl(S.text_lines(spark, root, r"\.jsonl$|/part-"), ID, tail="pi")
    is_header = (F.coalesce(V.string("v", "$.type"), F.lit("")) == "session") | (F.coalesce(V.string("v", "$.kind"), F.lit("")) == "header")
    head = records.filter(is_header).groupBy("path").agg(F.min("line").alias("start"), F.min_by(F.struct(V.string("v", "$.id").alias("id"), V.string("v", "$.cwd").alias("cwd"), V.string("v", "$.parentSession").alias("parent"), S.json_date(V.get("v", "$.timestamp"), F.lit(None)).alias("time"), F.coalesce(V.number("v", "$.version"), F.lit(1.0)).alias("version"), (F.coalesce(V.string("v", "$.kind"), F.lit("")) == "header").alias("lanes")), "line").alias("h")).select("path", "start", "h.*")
    headless = S.diagnostic(records.select("path").distinct().join(head, "path", "left_anti"), ID, "error", "pi_session_header_invalid", "The session does not start with a header.", "path")
    lanes = S.diagnostic(head.filter("lanes"), ID, "error", "pi_session_version_unsupported", "Lane sessions (version 4) are not supported.", "path")
    newer = S.diagnostic(head.filter(f"version > {VERIFIED} and not lanes"), ID, "warning", "pi_session_schema_newer", "The session's version is newer than the verified one.", "path")
    good = head.filter("not lanes")
    entries = records.filter(~is_header).join(good.select("path", "start", "version", "time"), "path").filter("line > start")
    kind = F.coalesce(V.string("v", "$.type"), F.lit(""))
    void = lambda p: F.coalesce(V.kind(V.get("v", p)) == "VOID", F.lit(False))
    narrow = entries.select("path", "line", "version", V.string("v", "$.id").alias("id"), V.string("v", "$.parentId").alias("parent"), void("$.parentId").alias("root"), (kind == "leaf").alias("leaf"), V.string("v", "$.targetId").alias("target"), void("$.targetId").alias("target_null"))
    # Only ids and pointers go to the helper; texts join back by line.
    walked = S.cut(branches(narrow), "branches")
    invalid = S.diagnostic(walked.filter("line = 0 and verdict = 'invalid'"), ID, "warning", "pi_session_tree_invalid", "The session's tree is ambiguous or broken; it was skipped.", "path")
    branch = entries.join(walked.filter("line > 0").select("path", "line", "place"), ["path", "line"])
    role = V.string("v", "$.message.role")
    said = branch.filter((kind == "message") & role.isin("user", "assistant"))
    text = visible(V.get("v", "$.message.content"), role == "user")
    at = S.json_date(V.get("v", "$.message.timestamp"), S.json_date(V.get("v", "$.timestamp"), F.coalesce("time", F.lit(S.EPOCH))))
    messages = said.select(F.col("path").alias("conv_key"), F.col("place").cast("long").alias("ord"), F.coalesce(V.string("v", "$.id"), F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("upstream_id"), role.alias("role"), at.alias("created_at"), text.alias("text"), F.when(role == "assistant", V.string("v", "$.message.model")).alias("model_id")).filter("text is not null")
    messages = S.settle(messages)
    names = records.filter(V.string("v", "$.type") == "session_info").groupBy("path").agg(F.max_by(V.string("v", "$.name"), "line").alias("name"))
    models = branch.groupBy("path").agg(F.max_by(V.string("v", "$.modelId"), F.when(V.string("v", "$.modelId").isNotNull() & (kind == "model_change"), F.col("place"))).alias("current"))
    valid = good.join(walked.filter("line = 0 and verdict = 'invalid'").select("path"), "path", "left_anti").withColumn("conv_key", F.col("path"))
    kept, none = S.split_empty(valid, messages, ID, "pi_no_messages", "path")
    done = kept.join(S.sessions(messages), "conv_key").join(names, "path", "left").join(models, "path", "left").withColumn("upstream_id", F.coalesce("id", file_stem("path")))
    conversations = done.select("conv_key", "upstream_id", S.best_title(session_title(F.lit(LABEL), "upstream_id"), "name").alias("title"), F.coalesce("time", "started").alias("started_at"), F.col("updated").alias("updated_at"), S.metadata(sourcePath=F.col("path"), format="pi-session-jsonl", workspaceDirectory=F.col("cwd"), parentSession=F.col("parent"), sessionVersion=F.col("version").cast("long"), currentModelId=F.col("current")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, messages, [bad, headless, lanes, newer, invalid, none])
