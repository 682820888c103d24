"""The trie of conversation prefixes, by van Emde Boas recursion.

Sequences of up to H = 2^k items are cut at half depth. Prefixes up to the cut are named: equal ones of one tree get the
smallest of their sequences as representative. The upper trie keeps the representatives' first halves with the weight of
all they stand for; the second halves make a forest with one tree for each name. Both are cut again, all trees of all
levels in the same jobs, until trees are one item deep and their distinct items are the nodes: k rounds of
grouped joins for depth 2^k, each over the sequences that are longer than the half alone. Totals go the other way: level by level, the sum of each lower tree is grafted onto the
upper trie's path to the name that it hangs from, and into the sum of the tree made of both. A message goes to each node of that path, so
the rows of a round are no more than those of its upper tries.

A node is named by its smallest member and its depth, (conv, depth). Items are 128-bit hashes of role and text; a half's name is two 64-bit
sums (exclusive or) of hashes of its places and items, pre-aggregated before they are shuffled. Text is never shuffled.

Rows: null role or text is the empty string; a null turn comes first; turns of one number are in order of their item's hash, so equal
rows stay, side by side; a null conv_id takes no part; conversations without turns are members of the root; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import keep, table

#: Turn numbers that are ranked together; parts of a conversation's turns follow one another by counts.
SPAN = 1024
#: Conversations that share a shelf, whose first is what the others begin with, and one more than the most turns taken of it.
SHELF, HEADS = 100, 6
#: Turns without a number come first.
NO_TURN = -(2**60)
EMPTY = hashlib.sha256(b"").hexdigest()

TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def item(*columns: str) -> Column:
    """128 bits of a SHA-256 over columns, each with its length before it."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    text = F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, k, item, chars): turns with their place k = 1, 2, ... in a conversation.

    Turns are ranked within spans of turn numbers, and the spans' counts are summed, so a long conversation is many groups.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(NO_TURN)).alias("span"),
        item("role", "text").alias("item"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
    )
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy("conv", "span").agg(F.count("*").alias("n")).select("conv", "span", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "item"))
    return rows.withColumn("place", place).join(spans, ["conv", "span"]).select("conv", (F.col("before") + F.col("place")).alias("k"), "item", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, members) of conversations that begin with the first h turns of their shelf's first one, then go on after their own first h.

    sequences: conv, depth, item, chars; members: conv, length. h is the crc32 of the decimal id modulo HEADS.
    """
    turns = keep(numbered_turns(conversations), "turns")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    heads = turns.filter((F.col("conv") % SHELF == 0) & (F.col("k") < HEADS)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "item", "chars"))).alias("head"))
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % SHELF).alias("shelf"))
    all_ = own.join(heads.withColumnRenamed("conv", "shelf"), "shelf", "left").withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    all_ = keep(all_.select("conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), F.slice("head", 1, F.col("taken").cast("int")).alias("head")), "rebuilt")
    first = all_.select("conv", F.explode("head").alias("x")).select("conv", F.col("x.k").alias("depth"), "x.item", "x.chars")
    later = turns.filter(F.col("k") > h).join(all_.select("conv", "h", "taken"), "conv").select("conv", (F.col("taken") + F.col("k") - F.col("h")).alias("depth"), "item", "chars")
    return keep(first.unionByName(later), "sequences"), all_.select("conv", "length")


def past_half(height: int) -> Column:
    """Whether a row's sequence goes on in the lower half of its tree."""
    return F.col("last") - (F.col("depth") - 1 - F.pmod(F.col("depth") - 1, F.lit(height))) > height // 2


def cut_in_half(rows: DataFrame, height: int) -> DataFrame:
    """Rows (tree, seq, depth, item, chars, w, last) of trees of `height`, whose sequences all go past half of it, in trees of half of it, with
    `next`, their representative there; a row stays if it is its own."""
    half = height // 2
    place = F.pmod(F.col("depth") - 1, F.lit(height))
    rows = rows.withColumn("base", F.col("depth") - 1 - place)
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    upper = rows.filter(place < half).groupBy("tree", "base", "seq").agg(mark("depth", "item").alias("a"), mark("item", "depth").alias("b"), F.max("w").alias("own"))
    same = ["tree", "base", "a", "b"]
    named = upper.groupBy(*same).agg(F.min("seq").alias("name"), F.sum("own").alias("all"))
    names = upper.join(named, same).select("tree", "base", "seq", "name", "all")
    pick = lambda above, below, name: F.when(place < half, above).otherwise(below).alias(name)
    return rows.join(names, ["tree", "base", "seq"]).select(
        "seq", "depth", "item", "chars",
        pick(F.col("name"), F.col("seq"), "next"), pick(F.col("tree"), F.col("name"), "tree"),
        pick(F.col("all"), F.col("w"), "w"), pick(F.col("base") + half, F.col("last"), "last"),
    )


def joined_ids(batches):
    """Runs of (conv, depth) in sorted ids to (conv, depth, first, ids): decimal and comma-joined, at most a batch in a row."""
    import pyarrow as pa

    for batch in batches:
        conv, depth, ids = (batch.column(c).to_pylist() for c in ("conv", "depth", "id"))
        starts = [i for i in range(len(ids)) if i == 0 or (conv[i], depth[i]) != (conv[i - 1], depth[i - 1])]
        ends = [*starts[1:], len(ids)]
        yield pa.RecordBatch.from_pydict({
            "conv": pa.array([conv[i] for i in starts], pa.int64()), "depth": pa.array([depth[i] for i in starts], pa.int64()), "first": pa.array([ids[i] for i in starts], pa.int64()),
            "ids": pa.array([",".join(map(str, ids[a:b])) for a, b in zip(starts, ends)], pa.string()),
        })


def id_digests(batches):
    """Sorted (conv, depth, first, ids) to (conv, depth, sha): one hash runs on over the rows of a node."""
    import pyarrow as pa

    at, digest = None, None
    make = lambda rows: pa.RecordBatch.from_pydict({"conv": pa.array([r[0][0] for r in rows], pa.int64()), "depth": pa.array([r[0][1] for r in rows], pa.int64()), "sha": pa.array([r[1] for r in rows], pa.string())})
    for batch in batches:
        done = []
        for conv, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("conv", "depth", "ids")]):
            if at != (conv, depth):
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield make(done)
    if digest is not None:
        yield make([(at, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, sha) of (conv, depth, id): SHA-256 of a node's ids, rising and comma-joined.

    Ids are sorted over all partitions and joined where they lie, so one node's ids are some long strings when they meet in a task, which reads them one by one.
    """
    order = ["conv", "depth", "id"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(joined_ids, "conv long, depth long, first long, ids string")
    return runs.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(id_digests, "conv long, depth long, sha string")


def prefix_trie(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """Every node of the trie of `sequences` (conv, depth, item, chars) of `members` (conv, length), the root too; see TRIE."""
    spark = sequences.sparkSession
    root, n_convs, deepest = members.agg(F.min("conv"), F.count("*"), F.max("length")).first()
    if root is None:
        return spark.createDataFrame([], TRIE)
    top = 1
    while top < deepest:
        top *= 2
    # Down: names and weights. A sequence takes part once its tree's half is shorter than it; until then its rows wait where they are.
    one = F.lit(1).cast("long")
    rows = sequences.join(members.withColumnRenamed("length", "last"), "conv").select(F.lit(root).cast("long").alias("tree"), F.col("conv").alias("seq"), "depth", "item", "chars", one.alias("w"), "last")
    rows, columns = keep(rows, "rows"), rows.columns
    levels, height = [], top
    while height > 1:
        levels.append(keep(cut_in_half(rows.filter(past_half(height)), height), "cut"))
        rows, height = rows.filter(~past_half(height)).unionByName(levels[-1].filter("next = seq").select(*columns)), height // 2
    nodes = keep(rows.groupBy("tree", "depth", "item").agg(F.min("seq").alias("conv"), F.sum("w").alias("n"), F.max("chars").alias("chars")), "nodes")
    # Back up: what row of a sequence lies on what node. Each row is looked up once, at the level where it got a representative.
    places = keep(rows.join(nodes.select("tree", "depth", "item", "conv"), ["tree", "depth", "item"]).select("seq", "depth", "conv", "tree"), "places")
    for level in reversed(levels):
        moved = level.filter("next <> seq").select("seq", "depth", "next").join(places.withColumnRenamed("seq", "next"), ["next", "depth"]).select("seq", "depth", "conv", "tree")
        places = places.unionByName(keep(moved, "moved"))
    # A tree's name is a sequence; its parent node is where that lies.
    above = nodes.withColumn("up", F.col("depth") - 1).join(places.select(F.col("seq").alias("tree"), F.col("depth").alias("up"), F.col("conv").alias("parent")), ["tree", "up"], "left").withColumn("parent", F.coalesce("parent", "tree"))
    above = keep(above, "above")
    kids = above.groupBy(F.col("parent").alias("conv"), F.col("up").alias("depth")).agg(F.count("*").alias("n_children"))
    own = above.join(kids, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = keep(own.select("conv", "depth", "tree", "parent", "n", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")), "own")
    # Totals of trees (conv, depth of their root), from one item deep to all; grafts are messages to nodes.
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    trees = keep(total(own.select(F.col("tree").alias("conv"), (F.col("depth") - 1).alias("depth"), "leaves", "saved"), "conv", "depth"), "trees")
    grafts, half = [], 1
    while half < top:
        height, place = 2 * half, F.pmod(F.col("depth") - 1, F.lit(2 * half))
        lower = trees.filter(F.col("depth") % height == half).select(F.col("conv").alias("seq"), ((F.col("depth") - half) / height).cast("long").alias("block"), "leaves", "saved")
        above = places.filter(place < half).select("seq", "depth", "conv", "tree", ((F.col("depth") - 1 - place) / height).cast("long").alias("block"))
        grafts.append(keep(above.join(lower, ["seq", "block"]).select("conv", "depth", "tree", "leaves", "saved"), "grafts"))
        onto = grafts[-1].filter((F.col("depth") - 1) % height == 0).select(F.col("tree").alias("conv"), (F.col("depth") - 1).alias("depth"), "leaves", "saved")
        trees = keep(total(trees.filter(F.col("depth") % height == 0).unionByName(onto), "conv", "depth"), "trees")
        half = height
    every = reduce(DataFrame.unionByName, [df.select("conv", "depth", "leaves", "saved") for df in [own, *grafts]])
    summed = own.select("conv", "depth", "parent", "n", "n_children").join(total(every, "conv", "depth"), ["conv", "depth"])
    whole = trees.filter("depth = 0").agg(F.coalesce(F.max("leaves"), F.lit(1)), F.coalesce(F.max("saved"), F.lit(0))).first()
    top_node = spark.createDataFrame([(root, 0, None, n_convs, own.filter("depth = 1").count(), *whole)], "conv long, depth long, parent long, n long, n_children long, leaves long, saved long")
    ending = members.filter("length > 0").select(F.col("conv").alias("seq"), F.col("length").alias("depth")).join(places, ["seq", "depth"]).select("conv", "depth", F.col("seq").alias("id"))
    ending = ending.unionByName(members.filter("length = 0").select(F.lit(root).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), F.col("conv").alias("id")))
    out = summed.unionByName(top_node).join(end_digests(keep(ending, "ending")), ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(i)) AS k, i, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || length(coalesce(text, ''))::VARCHAR || ':' || coalesce(text, '') AS i
        FROM conversations WHERE conv_id IS NOT NULL)),
h AS (
  SELECT c, c - c % 100 AS s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
p AS (SELECT h.c, h.h, least(h.h, coalesce(n, 0)) AS p FROM h LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY c) b ON b.c = h.s),
r AS (
  SELECT h.c, t.k AS d, i, chars FROM h JOIN t ON t.c = h.s AND t.k <= h.h
  UNION ALL SELECT p.c, p.p + t.k - p.h, i, chars FROM p JOIN t ON t.c = p.c AND t.k > p.h),
w AS (SELECT c, d, chars, sha256(string_agg(sha256(i), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r),
all_ AS (SELECT c, d, chars, key FROM w UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(d) AS len FROM all_ GROUP BY c),
n AS (SELECT d, key, min(all_.c) AS c, count(*) AS n, max(chars) AS chars, string_agg(CASE WHEN len = d THEN all_.c::VARCHAR END, ',' ORDER BY all_.c) AS ends FROM all_ JOIN l ON l.c = all_.c GROUP BY d, key),
e AS (
  SELECT n.*, u.c AS parent FROM n JOIN all_ v ON v.c = n.c AND v.d = n.d LEFT JOIN all_ a ON a.c = n.c AND a.d = n.d - 1 LEFT JOIN n u ON u.d = a.d AND u.key = a.key),
k AS (SELECT e.*, (SELECT count(*) FROM e x WHERE x.parent = e.c AND x.d = e.d + 1) AS kids FROM e),
s AS (
  SELECT a.d, a.key, sum(CASE WHEN k.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((k.n - 1) * k.chars) AS saved FROM k JOIN all_ a ON a.c = k.c AND a.d <= k.d GROUP BY a.d, a.key)
SELECT k.c AS conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.key = k.key
"""
