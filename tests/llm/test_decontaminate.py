import random
import re

from scrollmill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items, window=10):
    ws, hit, ids = split(text), set(), set()
    for item_id, t in items:
        it = split(t)
        m = min(window, len(it))
        pats = {tuple(it[i : i + m]) for i in range(len(it) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1 if m else 0):
            if tuple(ws[i : i + m]) in pats:
                hit.update(range(i, i + m))
                ids.add(str(item_id))
    return len(ws), len(hit), sorted(ids)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["Ab", "b", "c1", "é", "Ünd", "x"]
    say = lambda n: rng.choice([" ", "\n", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 14, 25]))) for i in range(12)] + [(50, None), (51, "!!"), (None, "b b b b"), (3, say(12))]
    items = [x for x in items if x[1] is None or len(split(x[1])) > 2 or x[0] == 7]
    rows = [(i, say(rng.randint(0, 60)) + " " + rng.choice(items)[1].__str__() + say(5), "s") for i in range(60)] + [(60, None, "s"), (61, "", "s"), (None, items[0][1], "s"), (1, items[0][1].upper(), None), (1, items[0][1].upper(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = [x for x in items if x[0] is not None]
    want = sorted(((r[0] if r[0] is not None else -1, *brute(r[1], usable)) for r in rows), key=str)
    for size in (dc.ROUND_BYTES, 40):
        out = dc.find_passages(docs, bench, round_bytes=size).select("doc_id", "n_words", dc.n_hit().alias("n"), "items").collect()
        assert sorted(((r[0] if r[0] is not None else -1, r[1], r[2], list(r[3])) for r in out), key=str) == want


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "a", 3), (2, "clean words", None, 1)], "doc_id long, text string, lang string, row int")
    bench = spark.createDataFrame([(9, "zero one two three four five six seven eight nine ten")], "item_id long, text string")
    left = dc.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean words", None, 1)]
    assert dc.remove_contaminated(docs, bench.limit(0)).count() == 2
    assert dc.find_passages(docs.limit(0), bench).count() == 0
