import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from scrollmill.llm import prefix_trie as pt

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns, digest = defaultdict(list), lambda r, t: hashlib.sha256(f"{len(r)}:{r}{len(t)}:{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        shelf = c - (abs(c) % 100) * (1 if c > 0 else -1)
        whole[c] = own.get(shelf, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in kids[p]) or 1
        saved = sum(totals[k][1] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        totals[p] = leaves, saved
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def trie(conversations):
    out = pt.prefix_trie(*pt.rebuilt(conversations))
    assert out.columns == NAMES
    rows = [tuple(r) for r in out.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_small_trees_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), 100, 150, 201, 207, -3, -150, 999]:
        for turn in range(rng.randint(1, 13)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a", "bé🙂", "", None])))
    # The same turn number twice, null turns, repeated rows, a null id, and a conversation whose first turns go and no shelf has any.
    rows += [(7, 2, "user", "tie"), (7, 2, "bot", "tie"), (8, None, "user", "first"), (8, None, "user", "first"), (None, 0, "user", "nobody"), (5000301, 0, "u", "gone"), (rows[0][0], rows[0][1], *rows[0][2:])]
    assert trie(table(spark, rows).selectExpr("*", "1 as depth", "2 as seq", "3 as tree")) == brute(rows)


def test_deep_and_common_conversations(spark):
    """One conversation of more turns than a span, many alike, and a depth that is no power of two."""
    deep = [(1, k, "u", f"t{k % 3}") for k in range(2100)] + [(2, k, "u", f"t{k % 3}") for k in range(2100) if k < 1300] + [(3, 5 * k, "u", "same") for k in range(1100)]
    alike = [(c, k, "u", "hello") for c in range(1000, 1400) for k in range(3)]
    rows = deep[::4] + alike
    assert trie(table(spark, rows)) == brute(rows)


def test_no_turns_and_no_rows(spark):
    gone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie(table(spark, [(gone, 0, "u", "x")])) == brute([(gone, 0, "u", "x")])
    assert trie(table(spark, [(None, 0, "u", "x")]).limit(0)) == set() == trie(table(spark, [(None, 0, "u", "x")]))


def test_query_matches_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(pt.ORACLE_SQL)
    names = [c[0] for c in want.description]
    out = pt.op13_prefix_trie(spark, sf_dir)
    assert {tuple(r) for r in out.select(*names).collect()} == set(want.fetchall())


def test_long_runs_of_ids(spark):
    ends = spark.range(30_000).selectExpr("id div 29000 as conv", "1L as depth", "id * 7 as id").repartition(5)
    ids = [str(7 * i) for i in range(30_000)]
    want = {(0, hashlib.sha256(",".join(ids[:29_000]).encode()).hexdigest()), (1, hashlib.sha256(",".join(ids[29_000:]).encode()).hexdigest())}
    assert {(r.conv, r.sha) for r in pt.end_digests(ends).collect()} == want
