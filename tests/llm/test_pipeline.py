"""The pipeline against a plain version of its stages."""

import collections
import zlib

import numpy as np

import corpus_pipeline as cp
from scrollmill.llm import decontaminate, langid, token_files
from scrollmill.llm.common import table


def test_run_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    predict = langid.Classifier(langid.dictionaries(langid.learnable(docs))).predict
    left = [r for r in docs.collect() if not predict(r.text)[3]]
    # Five-word shingle sets that are 0.8 alike, by comparing every two of them.
    rows = sorted(left, key=lambda r: r.doc_id)
    split = [r.text.encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * min(len(s), len(sets[j])) >= 4 * max(len(s), len(sets[j])) and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    left = [r for i, r in enumerate(rows) if find(i) == i]
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in left]
    matcher = decontaminate.Matcher([(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()], 10)
    left = {r.doc_id: r for r in left if not matcher.find(r.text)[1]}

    got = sorted(cp.run(spark, sf_dir).collect(), key=lambda r: r.start)
    copies, at = collections.Counter(r.doc_id for r in got), 0
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    enc = token_files.encoder(token_files.default_tokenizer())
    for r in got:
        ids = np.append(np.frombuffer(enc._pack([left[r.doc_id].text])[0], enc.dtype), 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    size = lambda t: len(t.split())
    total = sum(size(r.text) for r in left.values())
    taken = sum(size(left[d].text) * n for d, n in copies.items())
    assert abs(taken - 1.5 * total) < 0.1 * total


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes and out.count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
