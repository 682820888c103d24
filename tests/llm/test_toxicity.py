import random

import numpy as np

from scrollmill.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    syll = ["ba", "re", "to", "mi", "ku", "so", "len", "tar", "vid", "ong"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    bad = lambda: rng.choice(["grux", "zpleb"]) + rng.choice(syll)
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(5, 150))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), bad())
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_planted_stems_are_learned(spark):
    rows = corpus(700, 1)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(None, None, 1.0), (10_000, "", 1.0), (10_001, "é " * 30_000, 1.0)], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = tx.train(*tx.sample(docs, labels))
    out = {r.doc_id: r for r in tx.with_toxicity(docs, model).collect()}
    assert len(out) == 703 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    scored_rows = [(y, out[i].predicted) for i, _, y in rows]
    assert np.mean([a == b for a, b in scored_rows]) > 0.95
    fresh = corpus(200, 2)
    scored = tx.Scorer(model).scores([t for _, t, _ in fresh])
    assert np.mean([(s >= 0.5) == y for s, (_, _, y) in zip(scored, fresh)]) > 0.9


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.train(*tx.sample(docs, labels)) is None
    assert [(r.score, r.predicted) for r in tx.with_toxicity(docs, None).collect()] == [(0.0, 0)]
    assert tx.with_toxicity(docs.limit(0), None).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = tx.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    old = tx.np.float32
    g = rng.standard_normal((7, 3, 6 * tx.H))
    mask = np.array([[1, 1, 1]] * 4 + [[1, 0, 1]] * 3, bool)
    tape: list = []
    net.forward(g.astype(old), mask, tape)
    d = np.array([0.3, -0.2, 0.5])
    grad, dg = net.backward(tape, d, g.shape)
    loss = lambda: float(net.forward(g.astype(old), mask) @ d)
    for k in ("Uf", "Ub", "A", "v", "w", "a"):
        at = tuple(rng.integers(n) for n in net.p[k].shape)
        keep, e = net.p[k][at], 1e-3
        net.p[k][at] = keep + e
        up = loss()
        net.p[k][at] = keep - e
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3
    for at in ((0, 0, 1), (3, 1, 10), (6, 2, 30), (6, 1, 5)):
        keep, e = g[at], 1e-2
        g[at] = keep + e
        up = loss()
        g[at] = keep - e
        down = loss()
        g[at] = keep
        assert abs((up - down) / (2 * e) - dg[at]) < 2e-3


def test_batches_do_not_change_scores():
    rows = corpus(60, 4)
    model = tx.train([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [t for _, t, _ in rows] + ["", None, "one"]
    together = tx.Scorer(model).scores(texts)
    apart = [tx.Scorer(model).scores([t])[0] for t in texts]
    assert np.allclose(together, apart, atol=1e-4)
    assert tx.windows(0) == [0] and tx.windows(33) == [0, 24] and tx.windows(32) == [0]


def test_long_runs_are_read_to_their_end():
    run = "".join(f"{i:04d}" for i in range(2000, 2100))
    for n in (1, 40, 41, 59, 60, 61, 80, 81, 400):
        pieces = tx.words(f"a {run[:n]} b")[1:-1]
        assert max(map(len, pieces)) <= 40 and all(any(run[a : min(a + 20, n)] in p for p in pieces) for a in range(max(1, n - 19)))
    rows = corpus(700, 1)
    model = tx.train([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = ["bareto", "mikuso", "lentar", "vidong"] * 4
    ends = [[*clean, "gruxba"], [*clean, "zplebre"], [*clean, "lentar"]]
    scores = tx.Scorer(model).scores(["_".join(ws) for ws in ends])
    assert min(scores[:2]) > scores[2]


def plain_score(model, text):
    """The score by the definition: window by window, word by word, gate by gate."""
    import math

    p, ids = model["p"], model["ids"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def word_input(w):
        marked, grams = f"<{w}>".encode(), []
        for n in tx.NGRAMS:
            for i in range(len(marked) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for b in marked[i : i + n]:
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                grams.append((h ^ h >> 15) % tx.BUCKETS)
        return np.concatenate([p["Ew"][ids.get(w, 0)], p["Ec"][grams].mean(0)]).astype(float)

    def run(xs, d):
        h, out = np.zeros(tx.H), []
        for x in xs:
            gx, gh = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = sig(gx[: tx.H] + gh[: tx.H]), sig(gx[tx.H : 2 * tx.H] + gh[tx.H : 2 * tx.H])
            n = np.tanh(gx[2 * tx.H :] + r * gh[2 * tx.H :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    ws, best, at = tx.words(text), -math.inf, 0
    while True:
        xs = [word_input(w) for w in ws[at : at + tx.WINDOW]]
        states = np.array([np.concatenate(pair) for pair in zip(run(xs, "f"), run(xs[::-1], "b")[::-1])]).reshape(-1, 2 * tx.H)
        if len(states):
            e = np.exp(np.tanh(states @ p["A"] + p["a"]) @ p["v"])
            pooled = (e[:, None] * states).sum(0) / e.sum()
        else:
            pooled = np.zeros(2 * tx.H)
        best = max(best, float(pooled @ p["w"] + p["b"][0]))
        if at + tx.WINDOW >= len(ws):
            break
        at += tx.SCORE_STRIDE
    return float(sig(best - model["threshold"]))


def test_query_scores_match_plain_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = tx.train(*tx.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    got = {r.doc_id: r for r in tx.op5_toxicity(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[::3]:
        if len(r.text or "") < 30_000:
            want = plain_score(model, r.text)
            assert abs(got[r.doc_id].score - want) < 1e-3 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_sample_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    held = {i for i in (1, 2) if __import__("zlib").crc32(str(i).encode()) % 5}
    texts, marks = tx.sample(docs, labels)
    assert len(texts) == len(held) and sorted(marks) == sorted({1: 1, 2: 0}[i] for i in held)
