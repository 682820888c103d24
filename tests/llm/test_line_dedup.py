import hashlib
import random

from scrollmill.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    big = lambda d: 2**63 - 1 if d is None else d
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(big(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == big(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_random_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["a common line", " A common LINE\t", "short", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "x" * 200, "\r0123456789\r", "\xa0123456789", ""] + [f"line number {i}" for i in range(30)]
    rows = [(rng.randint(0, 40), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for _ in range(80)] + [(None, "a common line\nline number 1"), (100, None), (101, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int").repartition(5)
    for bits in (ld.MOST_BITS, 1 << 16, 64):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ld.dedup_lines(docs, most_bits=bits).collect()]
        assert sorted(got, key=str) == brute(rows)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_digests_of_the_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)), key=str)
    assert sorted(map(tuple, ld.op8_line_dedup(spark, sf_dir).collect()), key=str) == want


def test_clashing_names_pass_through(spark):
    names = ["_doc", "_drop", "doc", "mark", "key", "drop", "row", "first"]
    rows = [(i, f"a common line here\nown line of {i}", *[i] * len(names)) for i in range(5)] + [(2, "a common line here", *[9] * len(names))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = ld.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert sorted(tuple(r)[: len(docs.columns)] for r in got.collect()) == sorted(rows)
    assert sorted(r.n_dropped for r in got.collect()) == [0, 1, 1, 1, 1, 1]
