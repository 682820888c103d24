import math
import random

import pytest

from scrollmill.llm import topk


def brute(rows, every=3, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("group,block", [(topk.GROUP, topk.BLOCK), (40, 8)])
def test_against_brute_force(spark, group, block):
    rng = random.Random(7)
    vec = lambda: [rng.choice([0.5, -0.25, rng.gauss(0, 1)]) for _ in range(6)]
    same = vec()
    rows = [(i, same if i % 3 == 1 else vec()) for i in range(200)] + [(300, None), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (306, [float("nan")] * 6), (309, [float("inf")] + [0.0] * 5), (312, [1.0, 2.0]), (313, [3.0, -1.0]), (315, []), (318, [1e9] * 6), (None, vec())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    ints = topk.integer_vectors(df)
    got = topk.search(ints.filter("vec_id % 3 = 0"), ints, group=group, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert topk.search(ints.limit(0), ints).count() == 0


def test_small_blocks_of_queries_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    ints = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sorted(map(tuple, topk.search(ints.filter("vec_id % 5 = 0"), ints).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "SEED_ROWS", 32)
    assert sorted(map(tuple, topk.search(ints.filter("vec_id % 5 = 0"), ints, group=64, block=16).collect())) == want


def test_bounds_stop_the_search():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-5, 5, (600, 8)), rng.integers(800, 1000, (40, 8))])
    index = topk.Blocks(np.arange(640), rows, 16)
    q = np.full((1, 8), 7)
    ids, _, scored = index.top(-1, q[0], index.bounds(q)[0], -math.inf, 10)
    assert set(ids) <= set(range(600, 640)) and scored < 20


def test_rows_of_one_id_are_queries_of_their_own(spark):
    """A repeated query row, and one id with two vectors: each row has its own ten ranks."""
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(5)]
    rows = [(i, vec()) for i in range(1, 60)]
    rows += [(300, rows[4][1]), (300, rows[4][1]), (303, vec()), (303, vec())]
    ints = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = topk.search(ints.filter("vec_id >= 300"), ints).collect()
    assert sorted(map(tuple, got)) == [r for r in brute(rows) if r[0] >= 300] and len(got) == 40
