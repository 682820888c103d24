"""Exact top-k inner products by block-at-a-time pruning (Ding and Suel 2011).

Candidates are sorted by the signs of their products with a few random axes and cut into groups of neighbours, each group into
blocks; groups and blocks keep every dimension's largest and smallest component. For a query the sum over dimensions
of the larger of query times either bounds every score in a group or block. A query goes only to groups whose
bound reaches the score that its k-th cannot be below, known from a bounded sample; there blocks are taken by falling bound and
scored through their own rows until a bound lies below the k-th score so far.

A task holds one group of candidates and a bounded block of queries; a group's size follows from the rows and the cores.

Rows: a null vector, or one with null or non-finite components, takes no part; vectors only meet
vectors of their own length; a row is not its own candidate, nor are other rows of its vec_id; repeated rows and
ties are ranked by vec_id; a null vec_id takes no part. An empty table gives no rows. Components of 2**26 or more after
scaling are multiplied as Python integers and the scores held to 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import keep, new_folder, open_store, table

K, EVERY, SCALE = 10, 100, 1024
#: Rows: of a block of queries, of a group at least and at most, of a block, and of the sample that gives the first bounds.
QUERY_BLOCK, LEAST_GROUP, GROUP, BLOCK, SEED_ROWS = 8192, 1024, 65536, 64, 4096
AXES = 16
NONE = -(2**63)
#: Of each query and group also a row without vec_id, that tells how many blocks were scored, of how many.
FOUND = "n long, query_id long, vec_id string, score long, scored long, blocks long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): usable rows with floor(SCALE * x), x as double."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", x.alias("x")).filter(fine)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("v"))


def matrix(cells, dim: int) -> np.ndarray:
    """Rows of packed integers."""
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), dim)


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, v as bytes, code) of (vec_id, dim, v); code has the signs of v's products with AXES random axes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, dims, lists = batch.columns
            dims, flat, ends = dims.to_numpy(), lists.flatten().to_numpy(), lists.offsets.to_numpy()
            cells, code = [flat[a:b].astype("<i8").tobytes() for a, b in zip(ends - ends[0], ends[1:] - ends[0])], np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                axes = np.random.default_rng(int(dim)).standard_normal((int(dim), AXES))
                code[at] = (matrix([cells[i] for i in at], int(dim)) @ axes > 0) @ (1 << np.arange(AXES))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(cells, pa.binary()), pa.array(code)], names=["vec_id", "dim", "v", "code"])

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, v binary, code long")


def grouped(rows: DataFrame, size: int, folder: str) -> DataFrame:
    """Write the groups of packed rows, one row each: g, dim, ids, v, high and low as bytes. Parts are ranges of neighbours, even whatever repeats."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def out():
            dim = held[0][1]
            v = matrix([r[2] for r in held], dim)
            ids = np.array([r[0] for r in held], "<i8")
            cells = [[f"{part}-{n}"], [dim], [ids.tobytes()], [v.tobytes()], [v.max(0).tobytes()], [v.min(0).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.string(), pa.int32(), *[pa.binary()] * 4))], names=["g", "dim", "ids", "v", "high", "low"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= size or held[0][1] != row[1]):
                    yield out()
                    n, held = n + 1, []
                held.append(row)
        if held:
            yield out()

    n = max(1, math.ceil(rows.count() / size))
    placed = rows.withColumn("h", F.xxhash64("vec_id", "v")).withColumn("place", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = ["dim", "code", "h", "place"]
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "dim", "v")
    schema = "g string, dim int, ids binary, v binary, high binary, low binary"
    placed.mapInArrow(run, schema).write.parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while they are exact, Python integers beyond."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, q.shape[1])
    if 0 <= top < 2**53:
        return (q.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


class Blocks:
    """The block-forward index of one group of candidates."""

    @staticmethod
    def bound(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Queries by blocks: no score in the block is above it (one is added for rounding)."""
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        top = up @ high.T.astype(np.float64) + down @ low.T.astype(np.float64)
        size = up @ np.abs(high).T.astype(np.float64) - down @ np.abs(low).T.astype(np.float64)
        return np.maximum(top + size * 1e-9 + 1, float(NONE))

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int):
        dim = rows.shape[1]
        if len(ids) > block and dim:
            # Neighbours on a few random axes share a block, which tightens the maxima.
            axes = np.random.default_rng(dim).standard_normal((dim, 8))
            signs = (rows @ axes > np.median(rows @ axes, axis=0)) @ (1 << np.arange(8))
            order = np.lexsort((ids, signs))
        else:
            order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.starts = list(range(0, len(ids), block))
        self.high = np.array([self.rows[a : a + block].max(0) for a in self.starts]).reshape(len(self.starts), dim)
        self.low = np.array([self.rows[a : a + block].min(0) for a in self.starts]).reshape(len(self.starts), dim)
        self.block = block

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return self.bound(q, self.high, self.low)

    def top(self, query_id: int, q: np.ndarray, bounds: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(vec_ids, scores) of the best k at or above `floor`, and the blocks scored."""
        ids, scores, kth, n = np.zeros(0, np.int64), np.zeros(0, np.int64), floor, 0
        order = np.argsort(-bounds)
        for at in range(0, len(order), 8):
            some = order[at : at + 8][bounds[order[at : at + 8]] >= kth]
            if not len(some):
                break
            n += len(some)
            take = np.concatenate([np.arange(self.starts[b], min(self.starts[b] + self.block, len(self.ids))) for b in some])
            new = products(q[None, :], self.rows[take])[0]
            good = (new >= kth) & (self.ids[take] != query_id)
            ids, scores = np.concatenate([ids, self.ids[take][good]]), np.concatenate([scores, new[good]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                kth = max(kth, scores[-1])
        return ids, scores, n


def with_floors(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """(query_id, dim, v, floor): a score that the k-th best cannot be below, from a bounded sample of candidates (vec_id, dim, v)."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        import pyarrow as pa

        by_dim: dict[int, list] = {}
        for vec_id, dim, v in shared.value:
            by_dim.setdefault(dim, []).append((vec_id, v))
        index = {dim: (np.array([i for i, _ in found]), matrix([v for _, v in found], dim)) for dim, found in by_dim.items()}
        for batch in batches:
            ids, dims, cells = (c.to_pylist() for c in batch.columns)
            floors = []
            for i, dim, cell in zip(ids, dims, cells):
                known, rows = index.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                scores = products(matrix([cell], dim), rows)[0][known != i]
                floors.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else NONE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], names=["query_id", "dim", "v", "floor"])

    return queries.select("vec_id", "dim", "v").mapInArrow(run, "query_id long, dim int, v binary, floor long")


def probes(asked: DataFrame, folder: str) -> DataFrame:
    """(g, query_id, v, floor, n) of every query and each group whose bound reaches the floor; tasks read the groups' bounds in pieces."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = open_store(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
        for batch in batches:
            ids, dims, cells, floors, numbers = (c.to_pylist() for c in batch.columns)
            at: dict[int, list[int]] = {}
            for i, dim in enumerate(dims):
                at.setdefault(dim, []).append(i)
            for f in files:
                for piece in pq.ParquetFile(store.open_input_file(f)).iter_batches(1024, columns=["g", "dim", "high", "low"]):
                    gs, gdims, highs, lows = (c.to_pylist() for c in piece.columns)
                    for dim, own in at.items():
                        some = [j for j, d in enumerate(gdims) if d == dim]
                        if not some:
                            continue
                        high, low = (matrix([x[j] for j in some], dim) for x in (highs, lows))
                        for a in range(0, len(own), 512):
                            asks = own[a : a + 512]
                            reach = Blocks.bound(matrix([cells[i] for i in asks], dim), high, low) >= np.array([floors[i] for i in asks])[:, None]
                            q, g = np.nonzero(reach)
                            q = [asks[i] for i in q]
                            yield pa.RecordBatch.from_arrays([pa.array([gs[some[j]] for j in g], pa.string()), pa.array([ids[i] for i in q], pa.int64()), pa.array([cells[i] for i in q], pa.binary()), pa.array([floors[i] for i in q], pa.int64()), pa.array([numbers[i] for i in q], pa.int64())], names=["g", "query_id", "v", "floor", "n"])

    return asked.mapInArrow(run, "g string, query_id long, v binary, floor long, n long")


def _score(k: int, block: int):
    def run(group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["n", "query_id", "vec_id", "score", "scored", "blocks"]
        if not len(group) or not len(queries):
            return pd.DataFrame([], columns=names)
        dim = int(group["dim"].iloc[0])
        own = np.frombuffer(group["ids"].iloc[0], "<i8")
        index = Blocks(own, np.frombuffer(group["v"].iloc[0], "<i8").reshape(len(own), dim), block)
        found = []
        for a in range(0, len(queries), 256):
            part = queries.iloc[a : a + 256]
            q, ids, numbers = matrix(part["v"].tolist(), dim), part["query_id"].tolist(), part["n"].tolist()
            bounds = index.bounds(q)
            for i, floor in enumerate(part["floor"].tolist()):
                vec, score, n = index.top(ids[i], q[i], bounds[i], floor, k)
                found += [(numbers[i], ids[i], str(x), y, 0, 0) for x, y in zip(vec.tolist(), score.tolist())]
                found.append((numbers[i], ids[i], None, 0, n, len(index.starts)))
        return pd.DataFrame(found, columns=names)

    return run


def search_rows(queries: DataFrame, candidates: DataFrame, k: int = K, group: int | None = None, block: int = BLOCK) -> DataFrame:
    """The best k candidates of each group for every query, both (vec_id, dim, v), and how many blocks were scored."""
    spark = candidates.sparkSession
    rows, n_queries = keep(packed(candidates), "packed"), queries.count()
    n_rows = rows.count()
    group = group or min(GROUP, max(LEAST_GROUP, math.ceil(n_rows / (4 * spark.sparkContext.defaultParallelism))))
    folder = new_folder(spark, "groups")
    groups = grouped(rows, group, folder)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n_rows // SEED_ROWS))) == 0).select("vec_id", "dim", "v").limit(2 * SEED_ROWS)
    asked = keep(with_floors(packed(queries), [tuple(r) for r in sample.collect()], k), "asked").withColumn("n", F.monotonically_increasing_id())
    asked = keep(asked, "numbered")  # rows of one id are queries of their own
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    pairs = probes(asked, folder).withColumn("qb", F.pmod(F.xxhash64("n", F.lit(1)), F.lit(blocks)))
    left = groups.select("g", "dim", "ids", "v").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.groupBy("g", "qb").cogroup(pairs.groupBy("g", "qb")).applyInPandas(_score(k, block), FOUND)


def search(queries: DataFrame, candidates: DataFrame, k: int = K, group: int | None = None, block: int = BLOCK) -> DataFrame:
    """Best k candidates of every query row, both (vec_id, dim, v): query_id, rank, vec_id, score. Rows that share an id are ranked each for itself."""
    pairs = search_rows(queries, candidates, k, group, block).filter("vec_id is not null").select("n", "query_id", F.col("vec_id").cast("long").alias("vec_id"), "score")
    order = Window.partitionBy("n").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks_scored(queries: DataFrame, candidates: DataFrame, k: int = K, group: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per query that reached a group: blocks scored and blocks of the groups reached."""
    return search_rows(queries, candidates, k, group, block).groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("blocks").alias("blocks"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return search(rows.filter(F.col("vec_id") % EVERY == 0), rows)


ORACLE_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS n FROM e) q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
