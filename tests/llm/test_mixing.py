import random
import re

from scrollmill.llm import mixing as mx


def targets(sizes):
    """The rule by hand: share, hold what is above twice its size, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, held = 1.5 * sum(sizes.values()), {}
    while len(held) < len(sizes):
        unit = (budget - sum(held.values())) / sum(weight[s] for s in sizes if s not in held)
        above = [s for s in sizes if s not in held and unit * weight[s] > 2 * sizes[s]]
        if not above:
            return held | {s: unit * weight[s] for s in sizes if s not in held}
        held |= {s: 2.0 * sizes[s] for s in above}
    return held


def check(docs, got, slack):
    sizes, taken, largest, want = {}, {}, {}, None
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
        largest[s] = max(largest.get(s, 0), count(t))
    want = targets(sizes)
    source = {d: s for d, s, _ in docs}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack(largest[s])


def test_query_meets_targets_and_reruns_agree(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    first = mx.op10_mix_sources(spark, sf_dir).collect()
    assert len(first) == len(docs)
    check(docs, first, lambda m: m)
    assert sorted(map(tuple, mx.op10_mix_sources(spark, sf_dir).collect())) == sorted(map(tuple, first))


def test_nulls_ties_hot_source_and_small_chunks(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "b", "ü", "", None, "Z"]), rng.choice([None, "", *[" ".join("w" * rng.randint(1, 60)) for _ in range(6)]])) for i in range(600)]
    docs += [(7, docs[7][1], docs[7][2])] * 2
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    old, mx.CHUNK = mx.CHUNK, 64
    try:
        one = mx.mix_documents(df.withColumn("size", mx.F.lit(1))).groupBy("doc_id", "source").count().collect()
        two = mx.mix_documents(df.repartition(7).withColumn("size", mx.F.lit(1))).groupBy("doc_id", "source").count().collect()
    finally:
        mx.CHUNK = old
    assert sorted(map(str, one)) == sorted(map(str, two))
    words = lambda t: len((t or "").split())
    size = {d: (s, words(t)) for d, s, t in docs}
    taken = {}
    for r in one:
        taken[r.source] = taken.get(r.source, 0) + r["count"] * size[r.doc_id][1]
    sizes = {}
    for d, s, t in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 60 * 3
    assert mx.mix_documents(df.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(6)
    words, docs = [float(rng.randint(1, 500)) for _ in range(400)], [float(rng.randint(1, 3)) for _ in range(400)]
    pi = [0.3] * 400
    out = mx.flight(pi, words, docs, rng)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(w * (o - p) for w, o, p in zip(words, out, pi))) < 1e-3 and abs(sum(d * (o - p) for d, o, p in zip(docs, out, pi))) < 1e-5


def total(rows):
    return sum(r["count"] * r["size"] for r in rows)


def test_large_ids_beside_null_ids(spark, tmp_path):
    """60 ids from 2**53 + 1 and a null one: exactly these come back, and the mix meets the target."""
    docs = [(2**53 + 1 + i, "s", " ".join(["w"] * (1 + i % 7)), "en") for i in range(60)] + [(None, "s", "a b c", "en")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = mx.op10_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in docs)
    words = sum(len(t.split()) for _, _, t, _ in docs)
    assert abs(sum(r.taken for r in got) - 1.5 * words) <= 7
    kept = mx.mix_documents(df).collect()
    assert abs(sum(len(r.text.split()) for r in kept) - 1.5 * words) <= 7
    assert {(r.doc_id, r.text) for r in kept} <= {(d, t) for d, _, t, _ in docs}


def test_repeated_rows_meet_the_target_within_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mx, "PIECE", 64)
    docs = [(5, "s", "four words in it", i % 3) for i in range(1000)] + [(None, "s", f"some more words {i}", 0) for i in range(300)] + [(8, "t", "x y", 0)] * 7
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, other int").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {"s": 4 * 1300, "t": 14}
    want = targets(sizes)
    got = mx.op10_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source_size == sizes[s]) - want[s]) <= 4
    kept = mx.mix_documents(df).groupBy("doc_id", "source", "other").count().collect()
    assert abs(sum(r["count"] * 4 for r in kept if r.source == "s") - want["s"]) <= 4
    again = mx.mix_documents(df.repartition(3)).groupBy("doc_id", "source", "other").count().collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_ids_of_text_and_clashing_names(spark):
    names = ["_id", "_source", "_size", "_copies", "_copy", "row", "id", "hash", "size", "n", "base", "extra", "key", "part", "rank"]
    docs = [(f"d{i}", "ab"[i % 2], "one two three", *[i] * len(names)) for i in range(40)] + [("d1", "b", "one two three", *[9] * len(names))] * 3
    df = spark.createDataFrame(docs, ["doc_id", "source", "text", *names])
    left = mx.mix_documents(df)
    assert left.columns == df.columns and left.dtypes == df.dtypes
    assert set(map(tuple, left.collect())) <= set(docs) and abs(left.count() * 3 - 1.5 * 3 * 43) <= 9
