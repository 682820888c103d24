import random
import re

import numpy as np
import xxhash

from scrollmill.llm import simhash as sh
from scrollmill.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not ws:
        return 0
    runs = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_classes(rows):
    ids = [(d if d is not None else 2**63 - 1, fp) for d, fp in rows]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(ids[i][1] ^ ids[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return [best[find(i)] for i in range(len(ids))]


def test_fingerprints_match_the_definition():
    rng = random.Random(2)
    texts = [None, "", "One", "one  TWO", "a b c", "\xa0 É x y\tz\x0bq", *[" ".join(rng.choice("abcdeXY") for _ in range(rng.randint(1, 40))) for _ in range(60)]]
    assert [sh.fingerprint(t) % 2**64 for t in texts] == [brute_print(t) for t in texts]


def test_query_on_a_table_matches_brute_force(spark, sf_dir):
    got = sh.op7_simhash(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    best = dict(zip(prints, brute_classes(list(prints.items()))))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fp:016x}", best[d]) for d, fp in prints.items()}


def test_classes_of_planted_fingerprints(spark):
    rng = random.Random(3)
    fps = [0, 1, 3, (1 << 63) | 1]
    for _ in range(40):
        fp = rng.choice(fps + [rng.getrandbits(64)])
        for _ in range(rng.randint(0, 3)):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    rows = [(rng.randint(0, 1000), fp) for fp in fps] + [(None, 3), (None, 0xF0F0F0F0F0F0F0F0), (5, 0), (5, 0)]
    signed = [(d, fp - 2**64 if fp >= 2**63 else fp) for d, fp in rows]
    table = spark.createDataFrame(signed, "doc_id long, fp long").repartition(3)
    got = {(r.doc_id, r.fp): r.first for r in table.join(sh.classes(table), "fp").collect()}
    assert got == {r: c for r, c in zip(signed, brute_classes(rows))}


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "same words in this text", "a"), (2, "same words in this text", "b"), (3, "Same words in  this text", None), (4, "another thing is written over here", None), (4, "another thing is written over here", None), (None, "a third and lonely text without id", None), (9, None, None), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    left = sh.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "8", "None"]
    assert sh.drop_near_copies(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(99)) for _ in range(40))
    clean, copied = text(), text()
    rows = [(None, text()) for _ in range(30)] + [(7, clean), (7, copied), (3, copied), (11, text()), (11, text())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(4)
    left = sorted((str(r.doc_id), r.text) for r in sh.drop_near_copies(docs).collect())
    assert left == sorted((str(d), t) for d, t in rows if (d, t) != (7, copied))


def five_word_sets(texts):
    split = [(t or "").translate(LOWER).split() for t in texts]
    return [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set() for ws in split]


def brute_pairs(texts):
    sets = five_word_sets(texts)
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]


def test_near_copies_of_four_fifths_go(spark):
    """Planted copies, each with some words changed, in small groups and in one large one; only pairs of 0.8 or more are linked."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size in [rng.randint(1, 3) for _ in range(60)] + [80]:
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_pairs(texts):
        root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in sh.drop_near_copies(docs).collect()}
    assert left == {i for i in range(len(texts)) if find(i) == i}


def test_clashing_names_pass_the_stage(spark):
    names = ["_id", "_key", "_first", "_rank_", "id", "key", "row", "fp", "n", "count", "root", "best"]
    rows = [(1, "the same words stand in here", *[1] * len(names)), (2, "the same words stand in here", *[2] * len(names)), (3, "other words are over there now", *[3] * len(names))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    left = sh.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


def test_groups_whose_copies_are_near_to_one_text_alone(spark):
    """Copies with three changed words each: most are 0.8 alike to the first text only, and all but that go."""
    rng = random.Random(12)
    texts = []
    for size in (500, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(size - 1):
            copy = list(base)
            for at in rng.sample(range(5, 195), 3):
                copy[at] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in sh.drop_near_copies(docs).collect()) == [0, 500]


def test_pairs_that_share_no_print_go_too(spark):
    """Short texts with a word or an end of their own, and many that differ from all but one: a comparison of all pairs gives the same components."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(700):
        base = [word() for _ in range(rng.randint(24, 60))]
        texts.append(" ".join(base))
        texts.append(" ".join(base + [word() for _ in range((len(base) - 4) // 4)]))
    for _ in range(3):  # chains: each 0.8 alike to the one before and the one after
        base = [word() for _ in range(900)]
        texts += [" ".join(base[a : a + 300]) for a in range(0, 600, 30)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, holds = five_word_sets(texts), {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds.get(x, [])}:
            if len(s & sets[j]) * 5 >= len(s | sets[j]) * 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            holds.setdefault(x, []).append(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in sh.drop_near_copies(docs).collect()}
    assert left == {i for i in range(len(texts)) if find(i) == i}


def test_first_shingles_and_parities_of_sets(spark):
    """Sets 0.8 alike share a first shingle under any order, and their parities are close enough."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 60, 400):
        x = np.unique(rng.integers(0, 2**63, n, np.uint64))
        common = np.sort(rng.choice(x, n // 2, False))
        counts = rng.integers(3, 9, len(common))
        gone = n // 5
        y = np.sort(np.delete(x, rng.choice(n, gone, False)))
        assert set(sh.first_shingles(x, common, counts)) & set(sh.first_shingles(y, common, counts))
        apart = sum(bin((a ^ b) % 2**64).count("1") for a, b in zip(sh.parity(x), sh.parity(y)))
        assert apart <= gone and len(sh.first_shingles(x, common, counts)) == n - -(-n * 4 // 5) + 1


def test_tables_go_when_they_are_done(spark):
    """Near-dedup deletes the tables of its first rounds before the exact ones begin."""
    from scrollmill.llm import common

    start = common.kept_count()
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[: 30 + i])) for i in range(4)], "doc_id long, text string")
    assert sh.drop_near_copies(docs).count() >= 1
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._kept[start:]}
    assert not left & {"marked", "sets", "pairs", "neighbours", "spots", "placed", "apart"}


def test_wide_parities_tell_long_sets_apart(spark):
    """Sets of some thousand hashes, which 256 classes cannot tell apart: those under 0.8 by far go before their hashes meet, those of 0.8 and more never do."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**64, 40_000, np.uint64))
    shown = rng.permutation(base)
    sets = {1: shown[:4000], 2: shown[2000:6000], 3: shown[400:4000], 4: shown[:5000], 5: shown[:3999], 6: shown[:300], 7: shown[:240], 8: shown[30_000:34_000]}
    sets = {k: np.sort(v) for k, v in sets.items()}
    rows = [(k, len(v), sh.parity(v), sh.wide_parity(v)) for k, v in sets.items()]
    texts = spark.createDataFrame(rows, "fp long, n int, bits array<long>, wide array<long>")
    every = [(a, b) for a in sets for b in sets if a < b]
    pairs = sh.possible(spark.createDataFrame(every, "a long, b long"), texts.select("fp", "n", "bits"))
    told = {tuple(r) for r in sh.telling(pairs, texts.select("fp", "n", "wide")).collect()}
    alike = {(a, b) for a, b in every if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert (1, 4) in alike and (6, 7) in alike and alike <= told <= {tuple(r) for r in pairs.collect()}
    assert {(1, 2), (1, 8)} <= {tuple(r) for r in pairs.collect()} and not {(1, 2), (1, 8)} & told
    assert len(sh.wide_parity(base)) * 64 == 1 << 17 and sh.wide_parity(np.zeros(0, np.uint64)) == [0] * 4
