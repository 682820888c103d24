"""Importing registered sources again when files changed."""

from dataclasses import replace
from datetime import datetime

from scrollmill.operators.batch import Store, shared_path
from scrollmill.sources.base import files_signature, find_files
from scrollmill.streaming import refresh as refresh_module
from scrollmill.streaming.refresh import Spec, import_sources, refresh

AT = "2026-05-21T00:00:00.000Z"


def test_unchanged_sources_are_left_alone(spark):
    root = shared_path(spark, "logs")
    line = '{"type":"user","sessionId":"s1","uuid":"u1","timestamp":"2026-05-21T10:00:00Z","message":{"role":"user","content":"hello"}}'
    spark.createDataFrame([(line,)], "v string").coalesce(1).write.text(root)
    specs = [Spec("claude-code", root), Spec("codex", root + "-missing")]
    store, state = import_sources(spark, Store.new(spark), specs, AT)
    # A source that was never there is told of, too.
    assert sorted((r.source_id, r.conversations, r.messages, r.health) for r in store.status.collect()) == [("claude-code", 1, 1, "healthy"), ("codex", 0, 0, "absent")]
    state = spark.createDataFrame(state.collect(), state.schema)
    again, _ = import_sources(spark, store, specs, AT, skip_unchanged=True, known=state)
    assert again.conversations is store.conversations
    assert files_signature(find_files(spark, root, ".*")) == files_signature(find_files(spark, root, ".*"))


def line(session, uuid, text):
    return '{"type":"user","sessionId":"%s","uuid":"%s","timestamp":"2026-05-21T10:00:00Z","message":{"role":"user","content":"%s"}}\n' % (session, uuid, text)


def test_refresh_reads_changed_files_only(spark, tmp_path, monkeypatch):
    root, store_dir = tmp_path / "logs", f"file://{tmp_path}/store"
    root.mkdir()
    (root / "a.jsonl").write_text(line("s1", "u1", "hello"))
    (root / "b {1}[x].jsonl").write_text(line("s2", "u2", "other"))
    specs, told = [Spec("claude-code", f"file://{root}")], []
    source = refresh_module.SOURCES["claude-code"]
    monkeypatch.setitem(refresh_module.SOURCES, "claude-code", replace(source, read=lambda s, where: told.append(where) or source.read(s, where)))
    texts = lambda store: sorted(r.text for r in store.messages.collect())
    assert texts(refresh(spark, store_dir, specs, AT, now=1000.0)) == ["hello", "other"]
    with open(root / "b {1}[x].jsonl", "a") as f:
        f.write(line("s2", "u3", "more"))
    assert texts(refresh(spark, store_dir, specs, AT, now=1029.0)) == ["hello", "other"]
    assert texts(refresh(spark, store_dir, specs, AT, now=1031.0)) == ["hello", "more", "other"]
    assert texts(refresh(spark, store_dir, specs, AT, now=1100.0)) == ["hello", "more", "other"]
    assert len(told) == 2 and isinstance(told[0], str) and len(told[1]) == 1 and told[1][0].endswith("b \\{1\\}\\[x\\].jsonl")


def test_log_of_looks(spark, tmp_path, monkeypatch):
    """A look writes what changed; the log gives the state of the last look, before and after it is written whole."""
    monkeypatch.setattr(refresh_module, "MOST_LOOKS", 3)
    folder, at = str(tmp_path / "files"), 0
    for now in ({"a": 1, "b": 1}, {"a": 1, "b": 1}, {"a": 2, "c": 1}, {"c": 1, "b": 1}, {"c": 1, "b": 1, "d": 4}):
        at += 1
        state = spark.createDataFrame([("s", p, n, datetime(2026, 5, n)) for p, n in now.items()], refresh_module.STATE)
        read = lambda: spark.read.schema(refresh_module.LOG + ", looked long").parquet(folder)
        refresh_module.log_look(spark, folder, refresh_module.known_files(read()) if at > 1 else None, state, at)
        assert {r.path: r.length for r in refresh_module.known_files(read()).collect()} == now
        rows = {r.looked: r["count"] for r in read().groupBy("looked").count().collect()}
        assert rows[at] == {1: 3, 2: 1, 3: 4, 4: 3, 5: 2}[at]
        assert len(rows) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}[at]
