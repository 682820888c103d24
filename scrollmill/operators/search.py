"""Token index, BM25 and substring search, for one query or a table of queries."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import partial, reduce
from itertools import count
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.functions.text import TOKEN, ascii_lower, fold, query_terms, search_text, snippet
from scrollmill.functions.urls import conversation_uri
from scrollmill.operators import export
from scrollmill.operators.batch import Store, cut
from scrollmill.operators.recall import filter_local_day, filter_source, sources
from scrollmill.operators.windows import top_n

DEFAULT, MOST, WIDEN = 10, 50, 5
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Up to so many query tokens, or rows for each query, are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Queries that one scan of the messages tests by substrings.
QUERY_BLOCK = 100


def clamp_limit(value) -> int:
    """None, not finite or under 1: 10; else whole and at most 50."""
    if value is None or not math.isfinite(value) or value < 1:
        return DEFAULT
    return min(int(value), MOST)


#: Messages of a shard, on average; and tokens after which a shard goes on in a next block, so a block's memory is bounded.
PER_SHARD, BLOCK_TOKENS = 1024, 2_000_000
#: Blocks of a page at most: a file has some shards, each sorted by token, so a token is on few pages of each and the others are skipped.
PAGES = {"parquet.page.row.count.limit": "1000"}
#: Pairs of an edge; of more, neighbours become one that is better than both.
EDGE = 12
#: Up to so many tokens or shards stand as literals in a scan's filter; more are joined.
MOST_LITERALS = 1000
#: Shards that a ranked search scores first, to learn what score the others have to reach.
SEEDS = 16

BLOCK = (
    "token string, shard long, n long, sum_dl long, edge array<struct<tf: bigint, dl: bigint>>, "
    "postings array<struct<message_id: string, conversation_id: string, dl: bigint, tf: bigint, cols: array<struct<col: int, positions: array<int>>>>>"
)


@dataclass
class Index:
    """Blocks of postings, a row for each token and shard of messages, in files sorted by token and shard.

    A block has its number of messages and an edge: pairs of term frequency and length of which one is at least as good as any message
    in it, whatever the mean length; a scan of these columns alone bounds every score in it. The block without a token has a shard's lengths. `dead` (part_no, conversation_id) are rows of
    older parts of a store that no longer count.
    """

    blocks: DataFrame
    dead: DataFrame | None = None
    known: tuple | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """Postings of conversations that count."""
        return rows if self.dead is None else rows.join(self.dead, ["part_no", "conversation_id"], "left_anti")

    def postings(self, tokens=None, shards=None, columns=("message_id", "conversation_id", "dl", "tf", "cols")) -> DataFrame:
        """Live postings (token, shard, ...) of some tokens (None: all) and shards; both filters reach the files."""
        rows = self.blocks.filter("token is not null")
        if tokens is not None:
            rows = rows.filter(F.col("token").isin(list(tokens)))
        if shards is not None:
            rows = rows.filter(F.col("shard").isin(list(shards)))
        part = ["part_no"] if self.dead is not None else []
        # Only the columns asked for are read.
        of = F.arrays_zip(*[F.col(f"postings.{c}").alias(c) for c in columns]) if len(columns) < 5 else F.col("postings")
        return self.live(rows.select("token", "shard", *part, F.explode(of).alias("p")).select("token", "shard", *part, *[F.col(f"p.{c}").alias(c) for c in columns]))

    @property
    def lengths(self) -> DataFrame:
        """(message_id, conversation_id, dl) of every message."""
        rows = self.blocks.filter("token is null")
        part = ["part_no"] if self.dead is not None else []
        rows = rows.select(*part, F.explode(F.arrays_zip(*[F.col(f"postings.{c}").alias(c) for c in ("message_id", "conversation_id", "dl")])).alias("p"))
        return self.live(rows.select(*part, "p.message_id", "p.conversation_id", "p.dl")).select("message_id", "conversation_id", "dl")

    def totals(self) -> tuple[int, float]:
        """Rows and their mean length, counted once for an index."""
        if self.known is None:
            row = self.stats().first()
            self.known = (row.n_rows, row.avg_dl or 1.0)
        return self.known

    def many(self) -> bool:
        """Whether there are more messages than a search's first shards hold."""
        return self.totals()[0] > SEEDS * PER_SHARD

    def stats(self) -> DataFrame:
        if self.dead is not None:
            return self.lengths.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"), F.sum("dl").alias("n_tokens"))
        rows = self.blocks.filter("token is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sum("sum_dl").alias("n_tokens"))
        return rows.select("n_rows", (F.col("n_tokens") / F.nullif("n_rows", F.lit(0))).alias("avg_dl"), "n_tokens")

    def token_df(self, tokens=None) -> DataFrame:
        """(token, df): from the blocks' counts alone, unless some rows are dead."""
        if self.dead is not None:
            return self.postings(tokens, columns=("message_id", "conversation_id")).groupBy("token").agg(F.count("*").alias("df"))
        rows = self.blocks.filter("token is not null")
        return (rows if tokens is None else rows.filter(F.col("token").isin(list(tokens)))).groupBy("token").agg(F.sum("n").alias("df"))


def edge_of(postings: list[dict]) -> list[dict]:
    """The pairs (tf, dl) that no other pair beats in both, at most EDGE: with rising tf the length rises."""
    best: dict[int, int] = {}
    for p in postings:
        best[p["tf"]] = min(p["dl"], best.get(p["tf"], p["dl"]))
    out: list[list[int]] = []
    for tf, dl in sorted(best.items(), reverse=True):
        if not out or dl < out[-1][1]:
            out.append([tf, dl])
    step = -(-len(out) // EDGE)
    return [{"tf": out[a][0], "dl": out[min(a + step, len(out)) - 1][1]} for a in range(0, len(out), step or 1)]


def edges_of(code, tf, dl):
    """`edge_of` of many tokens at once: (pairs per token, tf, dl) of postings sorted by their token's number."""
    import numpy as np

    order = np.lexsort((dl, -tf, code))
    code, tf, dl = code[order], tf[order], dl[order]
    # Each token's values lie under those of all before it, so the least value so far is the token's own.
    value = dl - code * (int(dl.max()) + 1)
    best = value < np.concatenate([[value[0] + 1], np.minimum.accumulate(value)[:-1]])
    code, tf, dl = code[best], tf[best], dl[best]
    size = np.bincount(code)
    first = np.cumsum(size) - size
    at, step = np.arange(len(code)) - first[code], -(-size // EDGE)[code]
    last = (at % step == step - 1) | (at == size[code] - 1)
    return -(-size // -(-size // EDGE)), tf[at % step == 0], dl[last]


def index_blocks(batches, most: int):
    """Arrow batches of (shard, message_id, conversation_id, title, body), sorted by shard, to blocks; a shard's lengths are a block without a token."""
    import numpy as np
    import pyarrow as pa

    find = _token_pattern().findall
    names = ["token", "shard", "n", "sum_dl", "edge", "postings"]
    fresh = lambda: defaultdict(count().__next__)
    number: dict[str, int] = fresh()
    ids, owners, codes, sizes = [], [], [], []
    at, place, size = None, 0, 0

    def lists(counts, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def struct(**fields):
        return pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()], names=list(fields))

    def rows(tokens, n, dl_sums, edges, postings):
        shard = np.full(len(n), at << 20 | place, np.int64)
        return pa.RecordBatch.from_arrays([tokens, pa.array(shard), pa.array(n), pa.array(dl_sums), edges, postings], names=names)

    def posted(who, dl, tf, cols):
        return struct(message_id=messages.take(pa.array(who)), conversation_id=conversations.take(pa.array(who)), dl=dl, tf=tf, cols=cols)

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for shard, message, conversation, *texts in [*zip(*[c.to_pylist() for c in batch.slice(a, 256).columns])]:
                if shard != at or size >= most:
                    if ids:
                        messages, conversations = pa.array(ids, pa.string()), pa.array(owners, pa.string())
                        yield from blocks_of(number, codes, np.array(sizes, np.int64), lists, struct, rows, posted)
                    place = place + 1 if shard == at else 0
                    number, ids, owners, codes, sizes, at, size = fresh(), [], [], [], [], shard, 0
                found = [find(fold(text or "")) for text in texts]
                for tokens in found:
                    codes.append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
                ids.append(message)
                owners.append(conversation)
                sizes.append([len(tokens) for tokens in found])
                size += sum(sizes[-1]) + 1
    if ids:
        messages, conversations = pa.array(ids, pa.string()), pa.array(owners, pa.string())
        yield from blocks_of(number, codes, np.array(sizes, np.int64), lists, struct, rows, posted)


def blocks_of(number, codes, sizes, lists, struct, rows, posted):
    """The blocks of a shard: the tokens' numbers, those in each text, and the texts' lengths, a row for each message; sorted by token."""
    import numpy as np
    import pyarrow as pa

    width, dl = sizes.shape[1], sizes.sum(1)
    who, none = np.arange(len(dl)), lists(np.zeros(len(dl), np.int64), struct(col=np.zeros(0, np.int32), positions=pa.array([], pa.list_(pa.int32()))))
    edge = lists([1], struct(tf=np.zeros(1, np.int64), dl=dl.min(keepdims=True)))
    yield rows(pa.array([None], pa.string()), np.array([len(dl)]), dl.sum(keepdims=True), edge, lists([len(dl)], posted(who, dl, np.zeros(len(dl), np.int64), none)))
    if not number:
        return
    names = sorted(number)
    ranks = np.empty(len(names), np.int64)
    ranks[np.fromiter(map(number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
    flat = sizes.ravel()
    place = (np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)).astype(np.int32)
    text, code = np.repeat(np.arange(len(flat)), flat), ranks[np.concatenate(codes)]
    order = np.argsort(code, kind="stable")
    code, text, place = code[order], text[order], place[order]
    starts = lambda *keys: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    col = starts(code, text)
    post = starts(code[col], text[col] // width)
    cols = struct(col=(text[col] % width).astype(np.int32), positions=lists(np.diff(np.append(col, len(code))), pa.array(place)))
    own, who = code[col][post], text[col][post] // width
    tf = np.diff(np.append(col[post], len(code)))
    postings = posted(who, dl[who], tf, lists(np.diff(np.append(post, len(col))), cols))
    n = np.bincount(own)
    edges, edge_tf, edge_dl = edges_of(own, tf, dl[who])
    sums = np.add.reduceat(dl[who], np.cumsum(n) - n)
    whole = rows(pa.array(names, pa.string()), n, sums, lists(edges, struct(tf=edge_tf, dl=edge_dl)), lists(n, postings))
    yield from (whole.slice(a, 4096) for a in range(0, len(n), 4096))


def _token_pattern():
    import regex

    return regex.compile(TOKEN)


def sorted_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of (message_id, conversation_id, title, text, thinking): shard by shard, each sorted by token.

    Messages meet by shard, a hash of their id, are tokenized where they meet, and sorted there: the texts are shuffled once, the blocks never.
    """
    owner = F.col("conversation_id") if "conversation_id" in rows.columns else F.lit(None)
    shards = max(1, rows.count() // PER_SHARD)
    flat = rows.select(F.pmod(F.xxhash64("message_id"), F.lit(shards)).alias("shard"), F.col("message_id").cast("string").alias("message_id"), owner.cast("string").alias("conversation_id"), "title", search_text().alias("body"))
    return flat.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(index_blocks, most=BLOCK_TOKENS), BLOCK)


def build_index(rows: DataFrame) -> Index:
    """From (message_id, conversation_id, title, text, thinking): one full-text row per message, its title repeated in it.

    The blocks are written once and read by every use.
    """
    return Index(cut(sorted_blocks(rows), "index", **PAGES))


def index_part(spark: SparkSession, path: str, part: str) -> None:
    """Index a part of a store that has no index yet."""
    if not export.exists(spark, f"{path}/{part}/index/_SUCCESS"):
        own = export.read_part(spark, path, part, "messages").join(export.read_part(spark, path, part, "conversations").select(F.col("id").alias("conversation_id"), "title"), "conversation_id")
        sorted_blocks(own).write.options(**PAGES).mode("overwrite").parquet(f"{path}/{part}/index")


def index_of(spark: SparkSession, path: str, parts: list[str]) -> Index:
    if len(parts) == 1:
        return Index(export.read_part(spark, path, parts[0], "index", BLOCK))
    blocks = export.numbered(spark, path, parts, "index", BLOCK).withColumn("shard", F.col("part_no").cast("long") * (1 << 44) + F.col("shard"))
    return Index(blocks, export.outdated(spark, path, parts))


def store_index(spark: SparkSession, path: str) -> Index:
    """The index that lies beside a store; parts of the store that have none yet are indexed now, other parts are left as they are."""
    parts = export.parts_of(spark, path)
    for part in parts:
        index_part(spark, path, part)
    return index_of(spark, path, parts)


def merged_blocks(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The index of several parts as one: no text is read again, dead rows go, and small shards are put together.

    Blocks of the last part, where no row is dead, stay whole; all are shuffled once, by token and shard.
    An edge stays that of all the rows that were in its blocks, so it still bounds them; a long one becomes the one pair that is better than all.
    """
    index = index_of(spark, path, parts)
    shards = max(1, index.totals()[0] // PER_SHARD)
    rows = index.blocks.withColumn("shard", F.when(F.col("n") >= PER_SHARD // 2, F.xxhash64("shard").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)).otherwise(F.pmod(F.xxhash64("shard"), F.lit(shards))))
    last, key = F.col("part_no") == len(parts) - 1, ("token", "shard")
    held = rows.select(*key, "edge", F.when(last, F.col("postings")).alias("postings"))
    flat = rows.filter(~last).select(*key, "part_no", F.explode("postings").alias("p")).withColumn("conversation_id", F.col("p.conversation_id"))
    both = held.unionByName(index.live(flat).select(*key, F.array("p").alias("postings")), allowMissingColumns=True)
    blocks = both.groupBy(*key).agg(F.flatten(F.collect_set("edge")).alias("edge"), F.flatten(F.collect_list("postings")).alias("postings")).filter(F.size("postings") > 0)
    pair = F.array(F.struct(F.array_max(F.col("edge.tf")).alias("tf"), F.array_min(F.col("edge.dl")).alias("dl")))
    edge = F.when(F.size("edge") > 2 * EDGE, pair).otherwise(F.col("edge")).alias("edge")
    out = blocks.select(*key, F.size("postings").cast("long").alias("n"), F.aggregate("postings.dl", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_dl"), edge, "postings")
    return out.sortWithinPartitions(*key)


def asked_terms(queries: DataFrame) -> list[tuple]:
    """(query_id, term_no, term, parts) of (query_id, query); what a user asks, not data."""
    rows = []
    for r in queries.select("query_id", "query").collect():
        rows += [(r.query_id, i, term, _token_pattern().findall(fold(term))) for i, term in enumerate(query_terms(r.query))]
    return rows


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, term_no, term, parts): the phrases of (query_id, query); parts are a phrase's tokens in order."""
    return queries.sparkSession.createDataFrame(asked_terms(queries), "query_id long, term_no int, term string, parts array<string>")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """`df`, known to have so many rows at most, marked for broadcast if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def asked_tokens(asked: list[tuple]) -> set[str]:
    return {t for *_, parts in asked for t in parts}


ASKED = "query_id long, term_no int, term string, parts array<string>"


def phrase_hits(index: Index, asked: list[tuple] | DataFrame, shards: DataFrame | list | None = None) -> DataFrame:
    """(query_id, term_no, message_id, conversation_id, dl, freq): rows that hold a phrase; its tokens stand side by side in one column.

    `shards`: a list, or a table (query_id, shard) of those to look at.
    """
    spark = index.blocks.sparkSession
    asked = [tuple(r) for r in asked.collect()] if isinstance(asked, DataFrame) else asked  # what a user asks, not data
    tokens = asked_tokens(asked)
    terms = spark.createDataFrame(asked, ASKED)
    wanted = terms.select("query_id", "term_no", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "token"))
    rows = index.postings(tokens if len(tokens) <= MOST_LITERALS else None, shards if isinstance(shards, list) else None)
    hit = rows.join(sized(wanted, sum(len(parts) for *_, parts in asked)), "token")
    if isinstance(shards, DataFrame):
        hit = hit.join(shards, ["query_id", "shard"], "left_semi")
    key = ["query_id", "term_no", "message_id", "conversation_id", "dl"]
    single = hit.filter("n = 1").select(*key, F.col("tf").alias("freq"))
    if all(len(parts) == 1 for *_, parts in asked):
        return single
    # A phrase: shift each token's positions back to the phrase's start and keep what all share.
    many = hit.filter("n > 1").select(*key, "n", "k", F.explode("cols").alias("c")).select(*key, "n", "k", "c.col", "c.positions")
    starts = many.groupBy(*key, "col", "n").agg(F.collect_list(F.struct("k", "positions")).alias("ps"), F.count("*").alias("held"))
    shifted = F.transform("ps", lambda p: F.transform(p["positions"], lambda x: x - p["k"]))
    common = F.aggregate(F.slice(shifted, 2, F.greatest(F.size("ps") - 1, F.lit(0))), F.element_at(shifted, 1), lambda a, x: F.array_intersect(a, x))
    phrases = starts.filter("held = n").withColumn("tf", F.size(common).cast("long")).filter("tf > 0")
    return single.unionByName(phrases.groupBy(*key).agg(F.sum("tf").alias("freq")))


def idf_of(n_rows: int) -> Column:
    idf = F.ln((F.lit(n_rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def weight_of(avg_dl: float, freq: Column, dl: Column) -> Column:
    """What a term's idf is multiplied with, at a frequency and a length."""
    return freq * (K1 + 1) / (freq + K1 * (1 - B + B * dl / F.lit(avg_dl)))


def whole_queries(spark: SparkSession, asked: list[tuple]) -> DataFrame:
    """(query_id, n_terms) of the queries whose every term has a token; others have no ranked results."""
    terms: dict = {}
    for query_id, _, _, tokens in asked:
        terms.setdefault(query_id, []).append(len(tokens))
    return F.broadcast(spark.createDataFrame([(q, len(ns)) for q, ns in terms.items() if min(ns)], "query_id long, n_terms long"))


def scores_of(index: Index, hits: DataFrame, df: DataFrame, asked: list[tuple]) -> DataFrame:
    """(query_id, message_id, conversation_id, score) of the rows that hold every term; df (query_id, term_no, df)."""
    n_rows, avg_dl = index.totals()
    part = idf_of(n_rows) * weight_of(avg_dl, F.col("freq"), F.col("dl"))
    scored = hits.join(sized(df, len(asked)), ["query_id", "term_no"]).groupBy("query_id", "message_id", "conversation_id").agg((-F.sum(part)).alias("score"), F.count("*").alias("n"))
    return scored.join(whole_queries(hits.sparkSession, asked), "query_id").filter("n = n_terms").select("query_id", "message_id", "conversation_id", "score")


def term_frequencies(index: Index, asked: list[tuple]) -> DataFrame:
    """(query_id, term_no, df): of single tokens from the blocks' counts, of phrases by finding them."""
    spark = index.blocks.sparkSession
    single, phrases = [t for t in asked if len(t[3]) == 1], [t for t in asked if len(t[3]) > 1]
    tokens = asked_tokens(single)
    names = spark.createDataFrame([(q, n, parts[0]) for q, n, _, parts in single], "query_id long, term_no int, token string")
    out = sized(names, len(single)).join(index.token_df(tokens if len(tokens) <= MOST_LITERALS else None), "token").select("query_id", "term_no", "df")
    if phrases:
        out = out.unionByName(phrase_hits(index, phrases).groupBy("query_id", "term_no").agg(F.count("*").alias("df")))
    return out


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, message_id, conversation_id, score): all rows that hold every phrase; a lower score is better.

    A term without a token makes its query's ranked pass empty.
    """
    asked = asked_terms(queries)
    return scores_of(index, phrase_hits(index, asked), term_frequencies(index, asked), asked)


def block_bounds(index: Index, asked: list[tuple], df: DataFrame) -> DataFrame:
    """(query_id, shard, bound, least): for shards with blocks of all of a query's tokens, what no score in them exceeds (scores are negative: goes
    below), and how many messages of it may match. Postings are not read."""
    spark = index.blocks.sparkSession
    tokens = asked_tokens(asked)
    wanted = spark.createDataFrame(asked, ASKED).select("query_id", "term_no", F.size("parts").alias("parts"), F.explode(F.array_distinct("parts")).alias("token"), F.size(F.array_distinct("parts")).alias("distinct"))
    blocks = index.blocks.filter("token is not null") if len(tokens) > MOST_LITERALS else index.blocks.filter(F.col("token").isin(list(tokens)))
    n_rows, avg_dl = index.totals()
    best = F.array_max(F.transform("edge", lambda p: weight_of(avg_dl, p["tf"], p["dl"]))).alias("weight")
    met = blocks.select("token", "shard", "n", best).join(sized(wanted, sum(len(p) for *_, p in asked)), "token")
    terms = met.groupBy("query_id", "shard", "term_no", "distinct").agg(F.min("weight").alias("weight"), F.min("n").alias("least"), F.count("*").alias("held")).filter("held = distinct")
    bound = -F.sum(idf_of(n_rows) * F.col("weight"))
    found = terms.join(sized(df, len(asked)), ["query_id", "term_no"]).groupBy("query_id", "shard").agg(bound.alias("bound"), F.min("least").alias("least"), F.count("*").alias("n"))
    return found.join(whole_queries(spark, asked), "query_id").filter("n = n_terms").select("query_id", "shard", "bound", "least")


def top_scores(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `bm25_scores` among the first k of their query (and all that tie with the k-th), and (query_id, shard, bound, read).

    The shards with the best bounds are scored first; of the others only those whose bound reaches the k-th score found are read.
    """
    asked = asked_terms(queries)
    df = cut(term_frequencies(index, asked), "df")
    bounds = block_bounds(index, asked, df)
    order = Window.partitionBy("query_id").orderBy("bound", "shard")
    before = F.coalesce(F.sum("least").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = cut(bounds.withColumn("place", F.row_number().over(order)).withColumn("before", before), "bounds")
    seeds = bounds.filter((F.col("place") <= SEEDS) | (F.col("before") < k))
    score = lambda some: scores_of(index, phrase_hits(index, asked, some.select("query_id", "shard")), df, asked)
    first = cut(score(seeds), "first")
    reach = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    more = bounds.join(seeds.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(F.broadcast(reach), "query_id", "left")  # a row for each query
    more = cut(more.filter("reach is null or bound <= reach + 1e-9 * abs(reach)"), "more")
    read = bounds.join(seeds.select("query_id", "shard").union(more.select("query_id", "shard")).withColumn("hit", F.lit(True)), ["query_id", "shard"], "left")
    rows = first.unionByName(score(more))
    best = rows.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("rank") <= k).drop("rank")
    return best, read.select("query_id", "shard", "bound", F.coalesce("hit", F.lit(False)).alias("read"))


def best_per_conversation(scored: DataFrame, conversations: DataFrame, limit: int, all_of_them: bool = False) -> DataFrame:
    """The first 5 x limit message rows by (score, updated_at desc, message_id), then the best message of each conversation.

    Where `conversations` are all there are, only rows that their score leaves in the running are joined with them.
    """
    if all_of_them:
        scored = scored.withColumn("_rank", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("_rank") <= WIDEN * limit).drop("_rank")
    rows = scored.join(conversations.select(F.col("id").alias("conversation_id"), "updated_at"), "conversation_id")
    order = [F.col("score"), F.col("updated_at").desc(), F.col("message_id")]
    cut = top_n(rows, ["query_id"], order, WIDEN * limit, "row")
    best = cut.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "conversation_id").orderBy("row"))).filter("own = 1")
    return top_n(best, ["query_id"], [F.col("row")], limit).select("query_id", "rank", "conversation_id", "message_id", "score")


#: A piece that more than this share of the rows may hold leaves its query to the scan; up to so many conversations stand as literals in a scan of texts.
RARE, MOST_PAGES = 0.1, 128


def pieces_of(term: str) -> list[tuple[str, str]]:
    """(kind, piece): what tokens a text has to have to hold a term, ASCII case ignored.

    Runs of letters and digits in the folded term: inside it a run is a whole token, at its ends a token's tail or head, and a term that is one run is
    part of a token. Folding goes by single characters but for sigma at the end of a word; a term with one gives no pieces.
    """
    low = fold(term)
    if "\u03c3" in low or "\u03c2" in low:
        return []
    found = []
    for m in _token_pattern().finditer(low):
        first, last = m.start() == 0, m.end() == len(low)
        found.append(("part" if first and last else "tail" if first else "head" if last else "whole", m.group()))
    return list(dict.fromkeys(found))


def has_piece(kind: str, piece: str) -> Column:
    """Whether a token shows a piece; all four kinds reach the files of the index."""
    token = F.col("token")
    return {"part": token.contains, "tail": token.endswith, "head": token.startswith, "whole": token.__eq__}[kind](piece)


def with_pieces(index: Index, pieces: list[tuple]) -> DataFrame:
    """The index's blocks whose token shows one of (no, kind, piece), once for each, with `no`."""
    tests = [(n, has_piece(kind, piece)) for n, kind, piece in pieces]
    met = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in tests]))
    return index.blocks.filter(_any([test for _, test in tests])).withColumn("no", F.explode(met))


def _any(tests: list[Column]) -> Column:
    """A balanced disjunction: a long one is no deep tree."""
    while len(tests) > 1:
        tests = [reduce(or_, tests[a : a + 2]) for a in range(0, len(tests), 2)]
    return tests[0]


def substring_candidates(index: Index, asked: list[tuple]) -> tuple[DataFrame | None, list]:
    """(query_id, message_id, conversation_id) of the rows that may hold all terms of (query_id, terms), and the queries that need a scan instead.

    The counts of the index's blocks bound how many rows a piece leaves, before any postings are read; postings are read of tokens that show
    the rare pieces, and a row has to have all of these. Every row that holds the terms is among them.
    """
    spark = index.blocks.sparkSession
    pieces, of = [], {}
    for q, terms in asked:
        for kind, piece in dict.fromkeys(p for t in terms for p in pieces_of(t)):
            of.setdefault(q, []).append(len(pieces))
            pieces.append((len(pieces), kind, piece))
    bound, wanted = {}, []
    for a in range(0, len(pieces), QUERY_BLOCK):  # a row for each piece of what a user asks
        bound |= dict(with_pieces(index, pieces[a : a + QUERY_BLOCK]).groupBy("no").agg(F.sum("n")).collect())
    most = RARE * index.totals()[0]
    for q, numbers in of.items():
        rare = [n for n in numbers if bound.get(n, 0) <= most]
        wanted += [(q, n, len(rare)) for n in rare]
    rest = [q for q, _ in asked if q not in {q for q, *_ in wanted}]
    found = None
    part = ["part_no"] if index.dead is not None else []
    for a in range(0, len(wanted), QUERY_BLOCK):
        block = wanted[a : a + QUERY_BLOCK]
        ids = F.arrays_zip(*[F.col(f"postings.{c}").alias(c) for c in ("message_id", "conversation_id")])
        rows = with_pieces(index, [pieces[n] for _, n, _ in block]).select("no", *part, F.explode(ids).alias("p")).select("no", *part, "p.message_id", "p.conversation_id")
        own = index.live(rows).join(sized(spark.createDataFrame(block, "query_id long, no int, need int"), len(block)), "no").select("query_id", "no", "need", "message_id", "conversation_id")
        found = own if found is None else found.union(own)
    if found is not None:
        found = found.groupBy("query_id", "message_id", "conversation_id", "need").agg(F.count_distinct("no").alias("held")).filter("held = need").select("query_id", "message_id", "conversation_id")
    return found, rest


def substring_matches(messages: DataFrame, conversations: DataFrame, queries: DataFrame, limit: int, index: Index | None = None) -> DataFrame:
    """(query_id, rank, conversation_id, message_id): every term in title, text or thinking of one message, ASCII case ignored.

    With the messages' index, a query that has a rare piece looks only at the texts of rows whose tokens show its pieces. Other queries share one scan
    of the messages for each QUERY_BLOCK of them, their terms in the scan's own expressions.
    """
    asked = [(r.query_id, query_terms(r.query)) for r in queries.select("query_id", "query").collect()]  # the queries a user asks
    asked = [(q, [t.translate({i: i + 32 for i in range(65, 91)}) for t in terms]) for q, terms in asked if terms]
    holds = lambda t: F.contains("title", F.lit(t)) | F.contains("text", F.lit(t)) | F.contains("thinking", F.lit(t))
    shown = conversations.select(F.col("id").alias("conversation_id"), "title", "updated_at")
    low = lambda rows: rows.select(*[c for c in rows.columns if c not in ("title", "text", "thinking")], *[ascii_lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("title", "text", "thinking")])
    own = messages.select("conversation_id", "message_id", "created_at", "text", "thinking")
    columns = ("query_id", "conversation_id", "message_id", "created_at", "updated_at")
    whole = low(own.join(shown, "conversation_id"))
    hits = whole.limit(0).select(F.lit(0).cast("long").alias("query_id"), *columns[1:])
    some, rest = substring_candidates(index, asked) if index is not None and asked else (None, [q for q, _ in asked])
    if some is not None:
        some = cut(some, "candidates")
        ids = [r[0] for r in some.select("conversation_id").distinct().limit(MOST_PAGES + 1).collect()]
        if len(ids) <= MOST_PAGES:  # texts lie by conversation: equalities skip the pages of others
            own = own.filter(_any([F.col("conversation_id") == i for i in ids] or [F.lit(False)]))
        met = low(own.join(export.small(some.select("query_id", "message_id")), "message_id").join(shown, "conversation_id"))
        narrow = [(q, terms) for q, terms in asked if q not in set(rest)]
        for a in range(0, len(narrow), QUERY_BLOCK):
            hits = hits.union(met.filter(_any([(F.col("query_id") == q) & reduce(and_, map(holds, terms)) for q, terms in narrow[a : a + QUERY_BLOCK]])).select(*columns))
    wide = [(q, terms) for q, terms in asked if q in set(rest)]
    for a in range(0, len(wide), QUERY_BLOCK):
        met = F.array_compact(F.array(*[F.when(reduce(and_, map(holds, terms)), F.lit(q).cast("long")) for q, terms in wide[a : a + QUERY_BLOCK]]))
        hits = hits.union(whole.select(F.explode(met).alias("query_id"), *columns[1:]))
    best = hits.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "conversation_id").orderBy(F.col("created_at").desc(), "message_id"))).filter("own = 1")
    return top_n(best, ["query_id"], [F.col("updated_at").desc(), F.col("conversation_id")], limit).select("query_id", "rank", "conversation_id", "message_id")


def search_many(messages: DataFrame, conversations: DataFrame, index: Index, queries: DataFrame, limit=None) -> DataFrame:
    """Ranked results, filled up to the limit by substring results: query_id, rank, conversation_id, message_id, score."""
    limit = clamp_limit(limit)
    ranked = cut(best_per_conversation(bm25_scores(index, queries), conversations, limit, True), "ranked")  # used twice
    fill = substring_matches(messages, conversations, queries, limit, index if index.many() else None).join(ranked.select("query_id", "conversation_id"), ["query_id", "conversation_id"], "left_anti")
    both = ranked.withColumn("stage", F.lit(0)).unionByName(fill.withColumn("score", F.lit(0.0)).withColumn("stage", F.lit(1)))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "rank")))
    return placed.filter(F.col("place") <= limit).select("query_id", F.col("place").alias("rank"), "conversation_id", "message_id", "score")


def with_snippets(results: DataFrame, messages: DataFrame, queries: DataFrame, n_queries: int | None = None) -> DataFrame:
    """Add snippet and uri to results; only result rows reach the helper.

    The results are found once, written, and go to the messages, whose texts lie still in one scan; at most MOST rows of each query.
    """
    n_queries = queries.count() if n_queries is None else n_queries
    results = cut(results, "results")
    texts = messages.join(sized(results.select("message_id").distinct(), n_queries * MOST), "message_id", "left_semi").select("message_id", "text", "thinking")
    rows = results.join(texts, "message_id").join(sized(queries.select("query_id", "query"), n_queries), "query_id")
    return rows.withColumn("snippet", snippet("text", "thinking", "query")).withColumn("uri", conversation_uri("conversation_id")).drop("text", "thinking", "query")


def search(messages: DataFrame, conversations: DataFrame, index: Index, query: str, source_id=None, date: str | None = None, tz: str = "UTC", limit=None) -> DataFrame:
    """One query, with source and day filters (term statistics stay those of the whole corpus)."""
    if not query.strip():
        raise ValueError("a search query is required")
    some = filter_source(conversations, source_id)
    if date is not None:
        some = filter_local_day(some, date, tz)
    spark, limit, whole = messages.sparkSession, clamp_limit(limit), source_id is None and date is None
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    # A filter on conversations may drop the best rows, so only without one a search stops at the best blocks.
    scored = top_scores(index, queries, WIDEN * limit)[0] if whole and index.many() else bm25_scores(index, queries)
    # `limit` rows at most reach the driver; substrings are looked for only if the ranked pass leaves places free.
    rows = [(r["rank"], r.conversation_id, r.message_id, r.score) for r in best_per_conversation(scored, some, limit, whole).collect()]
    if len(rows) < limit:
        known = {r[1] for r in rows}
        fill = [r for r in substring_matches(messages, some, queries, limit, index if index.many() else None).collect() if r.conversation_id not in known]
        rows += [(0, r.conversation_id, r.message_id, 0.0) for r in sorted(fill, key=lambda r: r["rank"])]
    rows = [(0, n + 1, *r[1:]) for n, r in enumerate(sorted(rows, key=lambda r: r[0] or limit + 1)[:limit])]
    found = F.broadcast(spark.createDataFrame(rows, "query_id long, rank int, conversation_id string, message_id string, score double"))
    return with_snippets(found, messages, queries, 1).orderBy("rank")


def search_with_coverage(store: Store, index: Index, query: str, source_id=None, date: str | None = None, tz: str = "UTC", limit=None) -> tuple[DataFrame, DataFrame]:
    """The results of one query and, beside them, the status of the sources it covers."""
    return search(store.messages, store.conversations, index, query, source_id, date, tz, limit), sources(store.status, store.diagnostics, source_id)
