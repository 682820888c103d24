"""Cases of the rules: titles, snippets, times, URLs, replays, trees, readers, ranked search."""

import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrollmill.functions import text, times, urls
from scrollmill.functions import variants as V
from scrollmill.operators import recall, search, status
from scrollmill.operators.batch import shared_path
from scrollmill.sources import base, grok_build, kimi_code, opencode, pi


def values(spark, expr, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_titles(spark):
    rows = [("  a\n b c ",), ("x" * 80,), ("Repository: foo. Fix the bug",), ("",), (None,)]
    assert values(spark, text.title_from_text("t", F.lit("none")), rows, "t string") == ["a b c", "x" * 69 + "...", "Fix the bug", "none", "none"]
    assert values(spark, text.is_title("t"), [("<skill> x",), ("# AGENTS.md instructions for y",), ("hello",), ("  ",)], "t string") == [False, False, True, False]
    names = [("rollout-2026-05-21T10-11-12-abc",), ("short",), ("y" * 30,)]
    assert values(spark, text.session_title(F.lit("L"), "t"), names, "t string") == ["L session 2026-05-21 10:11", "L session short", "L session " + "y" * 21 + "..."]


def test_snippet_prefers_the_window_with_most_terms():
    body = "alpha " + "pad " * 100 + "beta alpha gamma " + "pad " * 100
    found = text.make_snippet(body, "alpha beta gamma")
    assert "beta alpha gamma" in found and found.startswith("...") and found.endswith("...") and len(found) <= 226
    assert text.make_snippet("  short \n text ", "x") == "short text"


def test_limits_and_days():
    assert [search.clamp_limit(v) for v in (None, 0, -3, float("nan"), 0.5, 7.9, 99)] == [10, 10, 10, 10, 10, 7, 50]
    assert times.local_day_range("2026-05-21", "America/Los_Angeles") == ("2026-05-21T07:00:00.000Z", "2026-05-22T07:00:00.000Z")
    assert times.local_day_range("2026-03-08", "America/Los_Angeles") == ("2026-03-08T08:00:00.000Z", "2026-03-09T07:00:00.000Z")
    for bad in ("2026-02-30", "21-05-2026", ""):
        with pytest.raises(ValueError):
            times.check_day(bad)


def test_times(spark):
    rows = [(1779357600000.0, None), (None, "1779357600000"), (None, "2026-05-21T10:00:00.123456Z"), (None, "2026-05-21"), (None, "no"), (None, None)]
    assert values(spark, times.iso_date("n", "t"), rows, "n double, t string") == ["2026-05-21T10:00:00.000Z", "2026-05-21T10:00:00.000Z", "2026-05-21T10:00:00.123Z", "2026-05-21T00:00:00.000Z", times.EPOCH, times.EPOCH]
    assert values(spark, times.seconds_or_millis("n", "t"), [(1779357600.0, None), (1779357600000.0, None), (None, "1779357600.5")], "n double, t string") == ["2026-05-21T10:00:00.000Z"] * 2 + ["2026-05-21T10:00:00.500Z"]


def test_content_of_many_shapes(spark):
    rows = [('{"c": " a "}',), ('{"c": ["x", {"text": "y"}, {"value": "z"}, {"type": "tool"}, 5]}',), ('{"c": {"content": "w"}}',), ('{"c": 5}',), ('{"c": ""}',), ("{}",), ("bad",)]
    assert values(spark, V.text_from_content(V.parse("j"), "$.c"), rows, "j string") == ["a", "x\ny\nz", "w", None, None, None, None]


def test_urls(spark):
    rows = ["https://u:p@Host.Example:443/a/b?q=1#f", "http://h", "http://h:8080/x", "javascript:alert(1)", "data:text/html,x", "ftp://h/x", None]
    want = ["https://host.example/a/b", "http://h/", "http://h:8080/x", None, None, None, None]
    assert values(spark, urls.clean_url("u"), [(r,) for r in rows], "u string") == want
    assert [urls.clean_one(r) for r in rows] == want
    marks = [(r"![a](<https://h/x?t=1>) ![b](https://h/y\_z 'title') ![c](data:x) [d](https://h/?k=1)",), ("plain",), (None,)]
    assert values(spark, urls.clean_images("t"), marks, "t string") == ["![a](https://h/x) ![b](https://h/y_z) ![c](removed:image) [d](https://h/?k=1)", "plain", None]
    cases = [("browser-extension-grok", "page_1", "https://grok.com/c/abc"), ("browser-extension-perplexity", "a_search_t1", None), ("browser-extension-chatgpt", "id", "https://chatgpt.com/c/id"), ("codex", None, None)]
    assert values(spark, urls.aliases("s", "i", "u"), cases, "s string, i string, u string") == [["abc", "page_1", "c_abc", "https://grok.com/c/abc"], ["t1", "a_search_t1"], ["id"], []]


def test_rewinds():
    user, agent = (lambda n, t, p=None: (n, 0, "user", t, p)), (lambda n, t: (n, 0, "agent", t, None))
    events = [user(1, "one", 0), agent(2, "a"), (3, 0, "thought", None, None), agent(4, "b"), user(5, "two", 1), agent(6, "c"), (7, 0, "rewind", None, 1), user(8, "three", 1), user(9, "echo"), (10, 0, "rewind", None, None), agent(11, "d"), (12, 0, "break", None, None), agent(13, "e")]
    assert [(r, t) for _, _, r, t in grok_build.replay(events)] == [("user", "one"), ("agent", "ab"), ("user", "three"), ("agent", "d"), ("agent", "e")]
    assert grok_build.replay([user(1, "x"), user(2, "y"), (3, 0, "rewind", None, 5)])[0][3] == "xy"
    assert grok_build.replay([user(1, "x", 0), (2, 0, "rewind", None, 0)]) == []


def test_what_kimi_users_saw():
    assert kimi_code.asked([{"type": "text", "text": "skill"}, {"type": "text", "text": "mine"}, {"type": "image_url"}], {"kind": "user", "skillActivations": [1]}) == "mine\n[image]"
    assert kimi_code.asked("x", {"kind": "skill_activation", "trigger": "user-slash", "skillName": "go", "skillArgs": " now "}) == "/go now"
    assert kimi_code.asked("x", {"kind": "skill_activation", "trigger": "auto", "skillName": "go"}) == "" == kimi_code.asked("<system-reminder>a</system-reminder>", None)


def tree(*rows):
    cols = ["line", "id", "parent", "root", "leaf", "target", "target_null"]
    return pd.DataFrame([(n + 1, i, p, p is None and i != "bad", leaf, target, gone) for n, (i, p, leaf, target, gone) in enumerate(rows)], columns=cols)


def test_session_trees():
    plain = lambda i, p: (i, p, False, None, False)
    assert pi.active_branch(tree(plain("a", None), plain("b", "a"), plain("x", "a"), plain("c", "b"))) == ([1, 2, 4], "ok")
    assert pi.active_branch(tree(plain("a", None), plain("b", "a"), plain("x", "a"), ("l", "x", True, "b", False))) == ([1, 2], "ok")
    assert pi.active_branch(tree(plain("a", None), ("l", "a", True, None, True))) == ([], "ok")
    for broken in (tree(plain("a", "b"), plain("b", "a")), tree(plain("a", "zz")), tree(plain("a", None), plain("a", None)), tree(plain("a", None), (None, "a", False, None, False))):
        assert pi.active_branch(broken) == ([], "invalid")


def test_json_lines_keep_numbers_and_tail(spark):
    path = shared_path(spark, "lines")
    spark.createDataFrame([('{"a": 1}\n\n[1]\n{"a": 1, "a": 2}\n{"cut": ',)], "v string").coalesce(1).write.text(path)
    base.tolerant(spark)
    records, bad = base.read_jsonl(base.text_lines(spark, path), "s", tail="s")
    assert sorted((r.line, r.a) for r in records.select("line", V.number("v", "$.a").alias("a")).collect()) == [(1, 1.0), (4, 2.0)]
    assert sorted((r.severity, r.code) for r in bad.collect()) == [("error", "jsonl_malformed"), ("info", "s_trailing_record_incomplete")]


def test_missing_tables(spark):
    b = opencode.from_relational(spark, {"session": spark.range(1)})
    assert b.conversations.count() == 0 and b.diagnostics.first().code == "opencode_schema_unsupported"


def test_diagnostics_summary(spark):
    rows = [("s", "info", "codex_no_messages", "3 x skipped", "b"), ("s", "info", "codex_no_messages", "2 x skipped", "a"), ("s", "info", "other", "m", None)]
    out = {r.code: r for r in status.summarize_diagnostics(spark.createDataFrame(rows, "source_id string, severity string, code string, message string, evidence_ref string")).collect()}
    assert out["codex_no_messages"].message == "2 codex_no_messages diagnostics were summarized. 5 source events or conversations were skipped."
    assert out["other"].message == "m"


MESSAGES = ["The quick brown fox", "café au lait and a fox fox", "foo-bar is one phrase", "bar foo apart", "評分提示應該 and text", "ｆｕｌｌ width", "fox", "nothing here"]


def test_scores_match_a_full_text_engine(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, content)")
    rows = [(str(i), f"title {i % 2} fox" if i % 3 == 0 else "", t, None) for i, t in enumerate(MESSAGES)]
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", [r[:3] for r in rows])
    index = search.build_index(spark.createDataFrame(rows, "message_id string, title string, text string, thinking string"))
    asked = ["fox", "cafe", "foo-bar", "quick fox", "評分", "width", "title", "zzz", "!!!", "full"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in search.bm25_scores(index, queries).collect():
        got.setdefault(asked[r.query_id], {})[r.message_id] = r.score
    for q in asked:
        want = dict(db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (" AND ".join(f'"{t}"' for t in text.query_terms(q)),)).fetchall())
        assert got.get(q, {}).keys() == want.keys()
        assert all(abs(got[q][k] - v) < 1e-9 for k, v in want.items())


def test_search_with_filters_and_fill(spark):
    m = spark.createDataFrame([("m1", "c1", "2026-05-21T01:00:00.000Z", "alpha beta", None), ("m2", "c2", "2026-05-22T01:00:00.000Z", "alphabet soup", "alpha thought"), ("m3", "c3", "2026-05-23T01:00:00.000Z", "none", None)], "message_id string, conversation_id string, created_at string, text string, thinking string")
    c = m.select(F.col("conversation_id").alias("id"), F.lit("").alias("title"), F.col("created_at").alias("updated_at"), F.lit("s").alias("source_id"))
    index = search.build_index(m.withColumn("title", F.lit("")))
    found = search.search(m, c, index, "alpha", limit=5).collect()
    assert {(r.conversation_id, r.message_id) for r in found} == {("c1", "m1"), ("c2", "m2")}
    assert [r.snippet for r in found if r.message_id == "m2"] == ["alphabet soup"]
    assert [r.message_id for r in search.search(m, c, index, "bet", limit=5).collect()] == ["m2", "m1"]
    assert [r.message_id for r in search.search(m, c, index, "alpha", date="2026-05-21").collect()] == ["m1"]
    with pytest.raises(ValueError):
        search.search(m, c, index, "  ")
    with pytest.raises(ValueError):
        recall.open_conversation(c, m, "zz")


def test_log_files_are_opened_once(spark):
    """All passes over numbered lines read one table; of small files a task opens many."""
    path = shared_path(spark, "logs")
    rows = [(f"s{i}", f'{{"n": {k}}}') for i in range(40) for k in range(3)]
    spark.createDataFrame(rows, "session string, v string").repartition(2, "session").write.partitionBy("session").text(path)
    base.tolerant(spark)
    lines = base.text_lines(spark, path)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan
    assert sorted(r.line for r in lines.collect()) == sorted([1, 2, 3] * 40)
    objects, _ = base.read_objects(spark, path, ".*", "s")
    assert "FileScan text" not in objects._jdf.queryExecution().sparkPlan().toString()


def test_sessions_of_a_task_run_over_its_batches(spark):
    """Each key's rows come together and in order, also across batches, and all tasks take part."""
    rows = spark.range(3000).selectExpr("case when id % 7 = 0 then null else concat('s', id % 70) end as s", "3000 - id as n", "cast(id as string) as t")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = base.per_session(rows, ["n"], lambda key, group: [(key, len(group), group == sorted(group))], "s string, size int, ordered boolean")
        assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        got = {r.s: (r.size, r.ordered) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {r.s: r["count"] for r in rows.groupBy("s").count().collect()}
    assert {k: n for k, (n, _) in got.items()} == want and all(o for _, o in got.values())
