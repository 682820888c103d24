"""The index of merged parts."""

from pyspark.sql import functions as F
from test_store import AT, a_batch

from scrollmill.operators import export, search
from scrollmill.operators.batch import Store, shared_path
from scrollmill.operators.merge import merge_change


def test_blocks_of_merged_parts_are_shuffled_once(spark):
    """Dead rows go, blocks are summed up anew, and no block is shuffled again for its edge or for its order."""
    path = shared_path(spark, "store")
    first = [(f"s{j}", n, f"word{j} text{n} text{n}") for j in range(6) for n in range(2)]
    export.write_change(merge_change(Store.new(spark), a_batch(spark, first), "partial", AT), path)
    again = [("s1", n, f"other{n} text{n}") for n in range(2)] + [("s9", 0, "new word1")]
    export.write_change(merge_change(export.read_store(spark, path), a_batch(spark, again), "partial", AT), path)
    parts = export.parts_of(spark, path)
    assert len(parts) == 2
    search.store_index(spark, path)
    out = search.merged_blocks(spark, path, parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning(token") == 1
    merged = search.Index(out.cache())
    store = export.read_store(spark, path)
    fresh = search.build_index(store.messages.join(store.conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id"))
    held = lambda i: sorted((r.token, r.message_id, r.conversation_id, r.dl, r.tf, str(r.cols)) for r in i.postings().collect())
    assert held(merged) == held(fresh)
    assert sorted(map(tuple, merged.lengths.collect())) == sorted(map(tuple, fresh.lengths.collect()))
    assert sorted(map(tuple, merged.token_df().collect())) == sorted(map(tuple, fresh.token_df().collect()))
    assert merged.stats().first() == fresh.stats().first()
    assert out.filter("n <> size(postings) or size(edge) = 0").count() == 0
