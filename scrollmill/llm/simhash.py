"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits over the word shingles of a text. Two fingerprints within distance 2
have a common neighbour within distance 1 of each, so every distinct fingerprint emits itself
and its 64 one-bit variants, and fingerprints that meet in a variant are candidates. At most 65
fingerprints can meet in one variant, whatever the data, so no bucket is hot; documents that share
a fingerprint are counted before anything is emitted.

`drop_near_copies`, the pipeline's stage, links texts whose sets of five-word shingles are 0.8 alike. Fingerprints over such
shingles lie too far apart for a small radius; fingerprints over a text's counted words lie near (3 % of their bits differ on
average at 0.8 and more), so each text has TABLES short ones of BITS bits. Each emits its ball of half the radius, texts that meet in a variant and
also in the least hash of their shingles are candidates: first side by side, then round by round with the best linked text of those that share a least
hash. That links nearly all at once; what it leaves is found exactly: two sets 0.8 alike share one of their first shingles in any order of all shingles, so
every pair of texts that do and that are not connected yet is bounded or verified (`ask_rest`). Every link is verified by its shingle sets.

Rows: a null or empty text has no words and fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated rows and equal doc_ids are each answered; a null doc_id
counts as the largest, and gives a null component_id where no other id is in its component. An
empty table gives no rows. Other columns pass through in `drop_near_copies`, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import drop_kept, free_shuffles, id_last, join_hot, keep, kept_count, table, with_text_columns
from scrollmill.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Of `drop_near_copies`: words of a shingle, least similarity (4 / 5), fingerprints and bits of each, and how far apart two texts of a sorted bucket may lie in the first round.
NEAR_SHINGLE, NEAR, TABLES, BITS, NEIGHBOURS = 5, (4, 5), 6, 10, 1
#: In how many of the variants that they share texts of equal fingerprints are paired, each time in another order.
SAME = 4
#: Texts that the order of shingles is learned from, shingles placed last by it, and texts of a shingle that the first exact round compares with all others of it.
SAMPLE, COMMON, HUBS = 100_000, 200_000, 16
#: Most classes of hashes of a text's wide parity.
WIDEST = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; bytes.lower and bytes.split are the ASCII rules that are asked for."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = map(join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [join(words)]
    hashes = np.fromiter((digest(x, SEED) for x in runs), np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def with_fingerprints(docs: DataFrame, name: str = "fingerprint_") -> DataFrame:
    """`docs` with a signed 64-bit fingerprint column."""
    return with_text_columns(docs, "text", f"{name} long", lambda: lambda texts: [[fingerprint(t) for t in texts]])


def links(prints: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of distinct fingerprints (column fp) within RADIUS, enough of them to connect all that are.

    Fingerprints that meet in a variant are all within distance 2 of each other, so a chain through
    each bucket in sorted order connects what all its pairs would.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("a")).filter("a is not null").select("a", F.col("fp").alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def classes(marked: DataFrame, fp: str = "fp", doc_id: str = "doc_id") -> DataFrame:
    """(fp, first, n): every distinct fingerprint with the smallest doc_id of its component and its number of rows."""
    prints = keep(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_last(doc_id)).alias("first"), F.count("*").alias("n")), "prints")
    roots = keep(components(links(prints)), "roots")
    linked = roots.join(prints, roots.node == prints.fp).select("fp", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    moved = linked.join(best, "root").select("fp", "best")
    return prints.join(moved, "fp", "left").select("fp", F.coalesce("best", "first").alias("first"), "n")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, first (smallest doc_id of its component; the largest long for null ids)."""
    marked = keep(with_fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "marked")
    return join_hot(marked, keep(classes(marked), "classes"), "fp", "n")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif(F.col("first"), F.lit(2**63 - 1)).alias("component_id"),
    )


def row_columns(docs: DataFrame) -> list:
    """id (nulls largest) and key, which names a row by its id and two hashes of all its columns; rows alike share it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.concat_ws("/", id_last("doc_id"), F.xxhash64(*columns), F.xxhash64(F.lit(SEED), *reversed(columns)))
    return [id_last("doc_id").alias("id"), key.alias("key")]


def survivors(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of `docs` for each component: the one of the smallest (doc_id, row hash), whatever ids its rows share.

    `prints` has a row for each text (fp, best = its smallest (id, key, n)), `roots` (node, root) those that are linked.
    """
    owned = prints.join(roots, prints.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "best")
    best = keep(owned.groupBy("root").agg(F.min("best").alias("best")).select("best.key", "best.n", F.col("best.n").alias("count")), "best")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = join_hot(docs.select(row, row_columns(docs)[1]), best, "key", "count")
    # Only rows that are repeated whole are grouped.
    once = found.filter("n > 1").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return found.filter("n = 1").select("row.*").unionByName(once)


def best_rows(marked: DataFrame) -> DataFrame:
    """(fp, best) of rows (fp, id, key): the smallest (id, key) of each text and how many rows are like it."""
    alike = marked.groupBy("fp", "id", "key").agg(F.count("*").alias("n"))
    return alike.groupBy("fp").agg(F.min(F.struct("id", "key", "n")).alias("best"))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles of some words, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = map(join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [join(words)]
    return np.unique(np.fromiter((digest(x, SEED) for x in runs), np.uint64))


def word_prints(words: list[bytes]) -> list[int]:
    """TABLES fingerprints of BITS bits: each bit is the majority of that bit in the hashes of the words, counted as often as they occur."""
    counted = Counter(words)
    total, votes = len(words), np.zeros(128, np.float64)
    some, weights = list(counted), np.fromiter(counted.values(), np.float64)
    for a in range(0, len(some), 16384):
        part = b"".join(map(xxhash.xxh3_128_digest, some[a : a + 16384]))
        votes += weights[a : a + 16384] @ np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 16), axis=1)
    bits = (votes[: TABLES * BITS] * 2 > total).reshape(TABLES, BITS)
    return (bits @ (1 << np.arange(BITS))).tolist()


_RNG = np.random.default_rng(SEED)
_XOR, _ODD = _RNG.integers(0, 2**64, (2, TABLES), np.uint64)
_ODD = _ODD | np.uint64(1)


def least(hashes: np.ndarray) -> list[int]:
    """TABLES signed minima of a set of hashes, each under a random order of its own."""
    out = np.full(TABLES, ~np.uint64(0))
    for a in range(0, len(hashes), 8192):
        out = np.minimum(out, ((hashes[a : a + 8192, None] ^ _XOR) * _ODD).min(0))
    return out.view(np.int64).tolist()


def first_shingles(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> list[int]:
    """Of n sorted hashes the first n - ceil(0.8 n) + 1 in an order of all hashes: by how often a sample shows them (`counts` of the sorted `common`, else 0), then by hash.

    Sets 0.8 alike have at least ceil(0.8 n) hashes in common, so each has one of those among its first, and the earliest of them is among the first of both.
    """
    n = len(hashes)
    held = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        held = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, held))[: n - -(-n * NEAR[0] // NEAR[1]) + 1]].view(np.int64).tolist()


def parity(hashes: np.ndarray) -> list[int]:
    """For each of 256 classes of hashes whether their number is odd: two sets differ in at least as many hashes as their bits."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_parity(hashes: np.ndarray) -> list[int]:
    """The same for as many classes as a set of that size needs to be told from others: a power of two, at least twice its hashes, up to WIDEST."""
    classes = min(WIDEST, max(256, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _marks(order):
    """`order`: a broadcast (common, counts)."""

    def make():
        common, counts = order.value

        def one(text):
            words = split_words(text)
            if not words:
                return 0, [], [], 0, [0] * 4, [0] * 4, []
            found, fp = shingles(words), int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))
            return fp, word_prints(words), least(found), len(found), parity(found), wide_parity(found), first_shingles(found, common, counts)

        return lambda texts: list(zip(*map(one, texts))) or [[]] * 7

    return make


def _shingle_lists():
    return lambda texts: [[shingles(split_words(t)).view(np.int64).tolist() for t in texts]]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least 3 texts of a sample hold, sorted, and how many do; of many the most frequent. They decide how fast `ask_rest` is, not what it finds."""
    every = max(8, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    held = with_text_columns(some, "text", "s array<long>", _shingle_lists).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = sorted((r.h % 2**64, r.n) for r in held.filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect())  # COMMON rows at most
    return np.array([h for h, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def neighbours(batches):
    """Pairs of rows (bucket, next, fp) at most NEIGHBOURS apart in one bucket of a sorted part; the part's first and last rows go out too.

    The low bits of `next` are the variant's number. Rows of one number have equal fingerprints and meet in all variants, so
    they are paired in the first SAME only.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["kind", "part", "bucket", "a", "b"]
    part, w, seen, tail = TaskContext.get().partitionId(), NEIGHBOURS, 0, [np.zeros(0, np.int64)] * 3

    def out(kind, bucket, a, b):
        size = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, part, np.int32)), *map(pa.array, (bucket, a, b))], names=names)

    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("bucket", "fp", "next")]
        if seen < w and len(new[0]):
            bucket, fp, _ = (c[: w - seen] for c in new)
            yield out(1, bucket, fp, fp)
        seen += len(new[0])
        old = len(tail[0])
        bucket, fp, place = rows = [np.concatenate([t, c]) for t, c in zip(tail, new)]
        k = place & 31
        for d in range(1, w + 1):
            at = np.arange(max(d, old), len(bucket))
            at = at[(bucket[at] == bucket[at - d]) & (fp[at] != fp[at - d])]
            at = at[(k[at] != k[at - d]) | (k[at] < SAME)]
            yield out(0, bucket[at], np.minimum(fp[at], fp[at - d]), np.maximum(fp[at], fp[at - d]))
        tail = [c[-w:] for c in rows]
    if (left := min(w, seen - w)) > 0:
        bucket, fp, _ = (c[-left:] for c in tail)
        yield out(2, bucket, fp, fp)


def near_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) first candidates of distinct texts (fp, prints, mins), a < b: those that meet in a variant of a fingerprint and in a least hash.

    A bucket's texts are within RADIUS bits of each other. It is sorted by other least hashes, which brings the most similar texts
    together, and each text is paired with those next to it, so a bucket of k texts gives fewer than NEIGHBOURS * k pairs; `ask_hubs` goes on from there.
    Sorting is global: parts are even whatever the buckets' sizes, and pairs across the parts' borders are found from their
    first and last rows.
    """
    spark = texts.sparkSession
    flips = F.array(*[F.lit(f) for f in [0, *[1 << i for i in range(BITS)]]])
    rows = texts.select("fp", "mins", F.posexplode("prints").alias("t", "print"))
    rows = rows.select("fp", "mins", "t", "print", F.get("mins", F.col("t")).alias("own"), F.posexplode(flips).alias("k", "flip"))
    # Each variant has an order of its own: by the high bits of two other least hashes, then by chance.
    other = lambda n: F.shiftrightunsigned(F.get("mins", (F.col("t") + 1 + (F.col("k") + n) % (TABLES - 1)) % TABLES), 43)
    place = F.shiftleft(other(0), 42).bitwiseOR(F.shiftleft(other(1), 21)).bitwiseOR(F.shiftleft(F.pmod(F.xxhash64("fp", "k"), F.lit(1 << 16)), 5)).bitwiseOR(F.col("k").cast("long"))
    rows = rows.select(F.xxhash64("t", F.col("print").bitwiseXOR(F.col("flip")), "own").alias("bucket"), place.alias("next"), "fp")
    ordered = rows.repartitionByRange("bucket", "next", "fp").sortWithinPartitions("bucket", "next", "fp").select("bucket", "next", "fp")
    found = keep(ordered.mapInArrow(neighbours, "kind int, part int, bucket long, a long, b long"), "neighbours")
    # Two runs of NEIGHBOURS rows at most for each part.
    edge = [(r.bucket, r.a) for r in sorted(found.filter("kind in (1, 2)").collect(), key=lambda r: (r.part, r.kind))]
    crossing = [(min(x[1], y[1]), max(x[1], y[1])) for d in range(1, NEIGHBOURS + 1) for x, y in zip(edge, edge[d:]) if x[0] == y[0] and x[1] != y[1]]
    return found.filter("kind = 0").select("a", "b").union(spark.createDataFrame(crossing, "a long, b long")).distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets (fp, s) have a Jaccard similarity of NEAR or more."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common * (NEAR[0] + NEAR[1]) >= (F.size("sa") + F.size("sb")) * NEAR[0]).select("a", "b")


def ask_hubs(spots: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and the (fp, spot) that the next round looks at.

    A spot holds the texts of one least hash. Its hub is the text with most links; every text of the spot that is not in the hub's component
    is compared with it, so a spot of k texts gives fewer than k pairs. What is in that component is settled there.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("degree"))
    known = degree.join(roots.withColumnRenamed("node", "fp"), "fp")
    placed = keep(spots.join(known, "fp", "left").select("fp", "spot", F.coalesce("root", "fp").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")), "placed")
    hubs = placed.filter("degree > 0").groupBy("spot").agg(F.max(F.struct("degree", "fp", "root")).alias("hub"))
    apart = keep(placed.join(hubs, "spot").filter("root <> hub.root").select("fp", "spot", F.col("hub.fp").alias("hub")), "apart")
    return apart.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct(), apart.select("fp", "spot")


def live_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, fp, root) of the rows (h, fp) whose shingle h has texts of several components; of shingles with the same texts one stays."""
    placed = keep(rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("h", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    marks = [F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(SEED))).alias("y")]
    held = placed.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *marks)
    return keep(placed.join(held.filter("low < high").groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h"), "h"), "live")


def fits(a: str, b: str):
    """Whether the sizes and parities of two sets (columns with these prefixes) leave it possible that they are 0.8 alike."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.get(f"{a}bits", F.lit(i)).bitwiseXOR(F.get(f"{b}bits", F.lit(i)))) for i in range(4)), F.lit(0))
    # Of n hashes in both, counted twice where common, c common ones suffice if c * 9 >= n * 4; n - 2 * c are in one only.
    return (F.least(na, nb) * NEAR[1] >= F.greatest(na, nb) * NEAR[0]) & (apart * (NEAR[0] + NEAR[1]) <= na + nb)


def possible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and parities (fp, n, bits) do not rule out."""
    side = lambda c: sizes.select(F.col("fp").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(fits("a_", "b_")).select("a", "b")


def telling(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs (a, b) that the wide parities (fp, n, wide) do not rule out: the longer one is folded to the shorter one's classes.

    Of long sets the 256 classes say little, and their whole sets are what takes disk; of these a pair costs a thirtieth.
    """
    side = lambda c: wide.select(F.col("fp").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide"))
    few = "least(size(a_wide), size(b_wide))"
    fold = lambda c: f"aggregate(sequence(i, size({c}_wide) - 1, {few}), 0L, (x, j) -> x ^ {c}_wide[j])"
    apart = f"aggregate(sequence(0, {few} - 1), 0, (s, i) -> s + bit_count({fold('a')} ^ {fold('b')}))"
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.expr(f"{apart} * {NEAR[0] + NEAR[1]} <= a_n + b_n")).select("a", "b")


def ask_rest(live: DataFrame, sizes: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare of rows (h, fp, root), and the (h, fp) that the next round looks at.

    The first `hubs` texts of each shingle meet all of it that are not connected with them, and are done there. A shingle of k texts makes at
    most hubs * k meetings in a round, and all of its pairs meet after some rounds. Sizes and parities (fp, n, bits) rule most pairs out as they meet.
    """
    order = Window.partitionBy("h").orderBy(F.xxhash64("fp"), "fp")
    ranked = keep(live.join(sizes, "fp").withColumn("place", F.row_number().over(order)), "ranked")
    first = ranked.filter(F.col("place") <= hubs).select("h", *[F.col(c).alias(f"hub_{c}") for c in ("fp", "root", "place", "n", "bits")])
    met = ranked.join(first, "h").filter(F.expr("root <> hub_root and place > hub_place") & fits("", "hub_"))
    return met.select(F.least("fp", "hub_fp").alias("a"), F.greatest("fp", "hub_fp").alias("b")).distinct(), ranked.filter(F.col("place") > hubs).select("h", "fp")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component: that of the smallest doc_id (of rows that share it, the one of the smallest hash).

    Two texts are linked when their sets of five-word shingles (64-bit hashes) have a Jaccard similarity of 0.8 or more. First candidates are
    neighbours in a bucket (`near_pairs`); then, as long as that links anything, the text with most links of each spot is compared with all that
    are not connected with it (`ask_hubs`); then all other pairs that may be links and are not connected yet (`ask_rest`). Texts of the same words are one.
    """
    spark, start = docs.sparkSession, kept_count()
    rows = docs.select(*row_columns(docs), F.col("text").alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(rows))
    added = "fp long, prints array<int>, mins array<long>, n int, bits array<long>, wide array<long>, first array<long>"
    marked = keep(with_text_columns(rows, "text", added, _marks(order)).drop("text"), "marked")
    prints = keep(best_rows(marked), "best_rows")
    same = ["prints", "mins", "n", "bits", "wide", "first"]
    texts = keep(marked.groupBy("fp").agg(F.first(F.struct(*same)).alias("x")).select("fp", "x.*"), "texts")
    drop_kept(start, ("best_rows", "texts"))
    sizes, wide = texts.select("fp", "n", "bits"), texts.select("fp", "n", "wide")

    def sets_of(pairs):
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = prints.join(nodes, "fp").select("fp", "best.key")
        held = rows.select("key", "text").join(wanted, "key").dropDuplicates(["fp"])
        return keep(with_text_columns(held, "text", "s array<long>", _shingle_lists).select("fp", "s"), "sets"), nodes

    pairs = keep(telling(possible(near_pairs(texts), sizes), wide), "pairs")
    sets, nodes = sets_of(pairs)
    links = keep(similar(pairs, sets), "near")
    spot = F.posexplode("mins").alias("t", "own")
    spots = keep(texts.join(nodes, "fp").select("fp", spot).select("fp", F.xxhash64("t", "own").alias("spot")).distinct(), "spots")
    roots = keep(components(links), "roots")
    while True:
        free_shuffles(spark)
        asked, spots = ask_hubs(spots, links, roots)
        found = keep(similar(telling(possible(asked, sizes), wide).join(pairs, ["a", "b"], "left_anti"), sets), "found")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = keep(components(links), "roots")
    drop_kept(start, ("best_rows", "texts", "near", "found", "roots"))
    held, hubs = texts.select("fp", F.explode("first").alias("h")), HUBS
    rest = keep(held.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1").select("h", "fp"), "rest")
    while True:
        free_shuffles(spark)
        before = kept_count()
        if (live := live_rows(rest, roots)).isEmpty():
            return survivors(docs, prints, roots)
        asked, rest = ask_rest(live, sizes, hubs)
        asked, rest = keep(telling(asked, wide), "asked"), keep(rest, "rest")
        found = keep(similar(asked, sets_of(asked)[0]), "found")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = keep(components(links), "roots")
        drop_kept(before, ("found", "rest", "roots"))
        hubs *= 4
