"""The store in parts: what a merge writes, what a read gives, versions, and looks that find nothing new."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scrollmill.operators import export, search
from scrollmill.operators.batch import Batch, Store, shared_path
from scrollmill.operators.merge import apply_change, merge_batch, merge_change, stored_keys
from scrollmill.sources import grok_build
from scrollmill.streaming.refresh import Spec, refresh

AT = "2026-05-21T00:00:00.000Z"


def a_batch(spark, rows, source="src"):
    """A batch of (session, turn, text)."""
    m = spark.createDataFrame([(s, source, n, f"m{n}", "user", f"2026-05-2{n % 9}T00:00:00.000Z", t) for s, n, t in rows], "conv_key string, source_id string, ord long, upstream_id string, role string, created_at string, text string")
    c = m.groupBy("conv_key", "source_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("updated_at"))
    return Batch.of(c.withColumn("upstream_id", F.col("conv_key")).withColumn("source_label", F.lit("S")).withColumn("title", F.col("conv_key")), m)


def texts(store):
    return sorted(r.text for r in store.messages.collect())


def test_parts_hold_what_changed_and_reads_take_the_latest(spark):
    path = shared_path(spark, "store")
    export.write_change(merge_change(Store.new(spark), a_batch(spark, [("a", 0, "a0"), ("b", 0, "b0"), ("c", 0, "c0")]), "full", AT), path)
    plain = export.read_store(spark, path)
    more = a_batch(spark, [("b", 0, "b0"), ("b", 1, "b1")])
    export.write_change(merge_change(plain, more, "partial", AT), path)
    store, parts = export.read_store(spark, path), export.parts_of(spark, path)
    assert texts(store) == ["a0", "b0", "b1", "c0"] == texts(merge_batch(plain, more, "partial", AT))
    assert len(parts) == 2 and export.read_part(spark, path, parts[1], "messages").count() == 2
    assert [(r.conversations, r.messages) for r in store.status.collect()] == [(3, 4)]
    assert texts(export.read_store(spark, path, 1)) == ["a0", "b0", "c0"]
    # A full import removes what it does not hold, also from earlier parts and from the index.
    search.store_index(spark, path)
    export.write_change(merge_change(store, a_batch(spark, [("c", 0, "c0"), ("d", 0, "d0")]), "full", AT), path)
    store = export.read_store(spark, path)
    assert texts(store) == ["c0", "d0"] and [(r.conversations, r.messages) for r in store.status.collect()] == [(2, 2)]
    assert sorted(r.token for r in search.store_index(spark, path).token_df().collect()) == ["c", "c0", "d", "d0"]
    export.write_change(merge_change(store, a_batch(spark, [("e", 0, "e0")]), "partial", AT), path)
    assert texts(export.read_store(spark, path)) == ["c0", "d0", "e0"]
    assert len(export.vacuum(spark, path, keep=1)) > 2 and texts(export.read_store(spark, path)) == ["c0", "d0", "e0"]


def test_parts_merge_by_size():
    for seed in range(20):
        rng, sizes, written, total = random.Random(seed), [], 0, 0
        for _ in range(400):
            sizes.append(rng.choice([1, 1, 1, 5, 80]))
            total += sizes[-1]
            while (n := export.to_merge(sizes)) > 1:
                written += sum(sizes[-n:])
                sizes[-n:] = [sum(sizes[-n:])]
            assert len(sizes) <= math.log2(total) + 2
        assert written <= total * math.log2(total)


def test_merged_parts_keep_rows_keys_and_index(spark):
    """Small merges: the index is carried over, and reads are those of the changes applied one by one."""
    path, plain, indexed = shared_path(spark, "store"), Store.new(spark), []
    for k in range(3):
        rows = [(f"s{j}", n, f"word{j} text{n}") for j in (k, k + 1) for n in range(2)]
        change = merge_change(export.read_store(spark, path) if k else plain, a_batch(spark, rows), "partial", AT)
        export.write_change(change, path)
        plain = apply_change(plain, change)
        parts = export.parts_of(spark, path)
        assert len(parts) <= 3
        indexed.append([export.exists(spark, f"{path}/{p}/index/_SUCCESS") for p in parts])
        index, store = search.store_index(spark, path), export.read_store(spark, path)
        assert texts(store) == texts(plain) and {r.id for r in store.conversations.collect()} == {r.id for r in plain.conversations.collect()}
        fresh = search.build_index(store.messages.join(store.conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id"))
        ask = spark.createDataFrame([(0, "word1"), (1, "text0 word2"), (2, "s1")], "query_id long, query string")
        scores = lambda i: sorted((r.query_id, r.message_id, round(r.score, 9)) for r in search.bm25_scores(i, ask).collect())
        assert scores(index) == scores(fresh)
        assert scores(index) == sorted((r.query_id, r.message_id, round(r.score, 9)) for r in search.top_scores(index, ask, 1000)[0].collect())
        keys = lambda df: sorted(tuple(r) for r in df.select("kind", "key", "id", "updated_at").collect())
        assert keys(store.keys) == keys(stored_keys(store.conversations))
    assert any(len(i) == 1 and i[0] for i in indexed[1:])  # a merge wrote the index of what it joined
    plan = store.keys.filter(F.col("bucket").isin(1, 2))._jdf.queryExecution().toString()
    assert "In(bucket, [1,2])" in plan


def test_two_writers_of_one_version(spark, monkeypatch):
    path = shared_path(spark, "store")
    change = merge_change(Store.new(spark), a_batch(spark, [("a", 0, "a0")]), "full", AT)
    export.write_change(change, path)
    monkeypatch.setattr(export, "latest_number", lambda *a: 0)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export.write_part(spark, path, {"gone": change.gone}, [])


def test_looks_without_news_write_no_version(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text('{"type":"user","sessionId":"s1","uuid":"u1","timestamp":"2026-05-21T10:00:00Z","message":{"role":"user","content":"hello"}}\n')
    (root / "notes.md").write_text("not a log")
    store_dir, specs = f"file://{tmp_path}/store", [Spec("claude-code", f"file://{root}"), Spec("codex", f"file://{root}-none")]
    for look in range(3):
        store = refresh(spark, store_dir, specs, AT, now=1000.0 + 100 * look)
        assert export.latest_number(spark, store_dir) == 2  # one for each source
    (root / "notes.md").write_text("still not a log")
    refresh(spark, store_dir, specs, AT, now=2000.0)
    assert export.latest_number(spark, store_dir) == 2
    status = {r.source_id: r for r in store.status.collect()}
    assert (status["codex"].health, status["codex"].conversations, status["codex"].last_import_at) == ("absent", 0, None)
    assert status["claude-code"].confidence == "stable" and len(status["claude-code"].schema_fingerprint) == 16


def test_workspaces_beside_sessions(spark, tmp_path):
    for name, cwd in (("one", "/work/one\n"), ("two", None)):
        folder = tmp_path / name / "s"
        folder.mkdir(parents=True)
        (folder / "updates.jsonl").write_text('{"method":"session/update","timestamp":1779357600,"params":{"update":{"sessionUpdate":"user_message_chunk","content":{"type":"text","text":"hi"}}}}\n')
        if cwd:
            (tmp_path / name / ".cwd").write_text(cwd)
    other = tmp_path / "three" / "s"
    other.mkdir(parents=True)
    (other / "updates.jsonl").write_text('{"kind":"something else"}\n')
    found = grok_build.read(spark, f"file://{tmp_path}").conversations.collect()
    assert sorted((r.metadata["sourcePath"].split("/")[-2], r.metadata.get("workspaceDirectory")) for r in found) == [("one", "/work/one"), ("two", None)]


def test_hidden_sessions_are_found_without_unread_summaries(spark, sf_dir, monkeypatch):
    """`grok_hidden` writes two files a session: its log and the summary that it reads."""
    from scrollmill.plans import import_queries, status_queries

    put, written = import_queries.put_lines, []
    for module in (import_queries, status_queries):
        monkeypatch.setattr(module, "put_lines", lambda rows, path, **more: written.append(path.rsplit("/", 1)[1]) or put(rows, path, **more))
    status_queries.grok_hidden(spark, sf_dir)
    assert sorted(written) == ["summary", "updates"]
