"""Mixing sources to target weights by cube-method balanced sampling (Deville and Tille 2004).

A source with target T and size S wants each document T/S times: floor(T/S) whole copies and an
inclusion probability for one more. Probabilities move through the null-space of two constraints,
the words and the documents of a source, until they are 0 or 1, in chunks of bounded size; the one or
two units that a chunk leaves go on to a coarser round, and the last ones of a source are landed by
trying their few roundings. Chunks come from hashes of doc_id and text and the random steps from the chunk's
name, so a rerun gives the same sample however the rows lie.

Rows: a null text has size 0; a null source is a source, last in order. Rows of equal doc_id, source and text are
one unit: of n such rows with probability p, floor(n p) get their extra copy and one fractional unit is left to
the sampling, so repeated rows cost no balance. A source without words keeps each row once, for 0 words. A doc_id of any type is
carried as text. An empty table gives no rows. Other columns pass through in `mix_documents`, whatever their names.
"""

from __future__ import annotations

import math
import random

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import keep, table

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
CHUNK, SHRINK = 4096, 8
#: Rows of one unit that one task answers at once.
PIECE = 100_000
#: Up to so many sources their targets are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(c: str):
    return F.coalesce(F.regexp_count(F.col(c), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, capped at `most` sizes, the excess reshared."""
    spark = sizes.sparkSession
    ranged = keep(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # one row a partition
    starts = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    if not starts:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target"))
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = keep(ranged.join(offsets, "part").select("source", "source_size", weight.alias("w")), "ranked")
    cap = most * F.col("source_size")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        above = cap < unit * F.col("w")
        held, free = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        new = (budget - held) / free if free else unit
        if not free or new <= unit:
            break
        unit = new
    return ranked.select("source", "source_size", F.least(cap, unit * F.col("w")).alias("target"))


def flight(pi: list[float], words: list[float], docs: list[float], rng: random.Random) -> list[float]:
    """Move probabilities along the null-space of both totals; two fractional units at most stay if docs and words differ."""
    pi = list(pi)
    waiting = [i for i, p in enumerate(pi) if 0 < p < 1]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            return pi
        i, j, k = active
        v = (docs[j] * words[k] - docs[k] * words[j], docs[k] * words[i] - docs[i] * words[k], docs[i] * words[j] - docs[j] * words[i])
        if not any(v):  # the same words per document: any two of them trade
            v = (docs[j], -docs[i], 0.0)
        up = down = math.inf
        for u, d in zip(active, v):
            if d > 0:
                up, down = min(up, (1 - pi[u]) / d), min(down, pi[u] / d)
            elif d < 0:
                up, down = min(up, pi[u] / -d), min(down, (1 - pi[u]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for u, d in zip(active, v):
            p = pi[u] + step * d
            pi[u] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        active = [u for u in active if 0 < pi[u] < 1]


def land(pi: list[float], words: list[float], docs: list[float], owed: float) -> list[float]:
    """Round the units that are left so that the words come closest to their total, `owed` before included."""
    left = [i for i, p in enumerate(pi) if 0 < p < 1]
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(words[u] * ((m >> b & 1) - pi[u]) for b, u in enumerate(left)) - owed), abs(sum(docs[u] * ((m >> b & 1) - pi[u]) for b, u in enumerate(left))), m))
    pi = list(pi)
    for b, u in enumerate(left):
        pi[u] = float(best >> b & 1)
    return pi


def _round(level: int, last: bool):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # Large documents settle first, so that small ones are left to land.
        frame = frame.assign(order=[xxhash.xxh64_intdigest(f"{d}|{h}") for d, h in zip(frame["id"], frame["hash"])], band=-frame["size"].map(lambda x: int(x).bit_length()))
        frame = frame.sort_values(["band", "order", "id", "hash"], kind="stable")
        words, docs = frame["size"].astype(float).tolist(), [1.0] * len(frame)
        pi = flight(frame["pi"].tolist(), words, docs, random.Random(xxhash.xxh64_intdigest(f"{key[0]!r}|{key[1]}|{level}")))
        return frame[["id", "source", "hash", "size"]].assign(pi=land(pi, words, docs, 0.0) if last else pi)

    return run


UNIT = ["id", "source", "hash"]


def same_unit(left: str, right: str):
    """Whether the rows of two aliases are of one unit; ids and sources may be null."""
    a, b = F.col(f"{left}.id"), F.col(f"{right}.id")
    c, d = F.col(f"{left}.source"), F.col(f"{right}.source")
    return (F.col(f"{left}.hash") == F.col(f"{right}.hash")) & a.eqNullSafe(b) & c.eqNullSafe(d)


def sampled(state: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, source, hash, pi) of units (id, source, hash, size, pi) with 0 < pi < 1: pi moved to 0 or 1."""
    moving = (F.col("pi") > 0) & (F.col("pi") < 1)
    n, level, done = None, 0, []
    while True:
        open_ = state.filter(moving)
        rest = open_.count()
        if not rest:
            break
        n = max(1, math.ceil(rest / chunk)) if n is None else max(1, min(math.ceil(rest / chunk), n // SHRINK))
        grouped = open_.withColumn("chunk", F.pmod(F.xxhash64("id", "hash", F.lit(level)), F.lit(n)).cast("long")).groupBy("source", "chunk")
        state = keep(grouped.applyInPandas(_round(level, n == 1), "id string, source string, hash long, size long, pi double"), "flight")
        done.append(state.filter(~moving))
        if n == 1:
            break
        level += 1
    out = state.filter(~moving) if not done else done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*UNIT, "pi")


def copies(units: DataFrame) -> DataFrame:
    """`units` (id, source, hash, size, n, source_size, target) with `base`, how often each of its n rows is taken, and `extra`, how many of them once more."""
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(1.0)
    state = units.withColumn("base", F.floor(ratio + 1e-12).cast("long")).withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("base")) * F.col("n"))
    state = state.withColumn("whole", F.floor(F.col("part") + 1e-9).cast("long")).withColumn("pi", F.col("part") - F.col("whole"))
    state = keep(state.withColumn("pi", F.when(F.col("pi") < 1e-9, 0.0).otherwise(F.col("pi"))).drop("part"), "units")
    settled = sampled(state.filter("pi > 0").select(*UNIT, "size", "pi")).filter("pi > 0.5")
    more = state.alias("u").join(settled.alias("s"), same_unit("u", "s"), "left")
    extra = F.col("u.whole") + F.col("s.hash").isNotNull().cast("long")
    return more.select("u.*", extra.alias("extra")).drop("whole", "pi")


def unit_columns(docs: DataFrame) -> list:
    """id, source, hash and size of the rows of `docs` (doc_id, text, source)."""
    return [F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("hash"), word_count("text").alias("size")]


def plan_mix(docs: DataFrame) -> DataFrame:
    """The units of `docs` (doc_id, text, source) with their targets and copies; texts are only counted and hashed."""
    units = keep(docs.select(*unit_columns(docs)).groupBy(*UNIT, "size").agg(F.count("*").alias("n")), "sized")
    targets = keep(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    side = targets.withColumnRenamed("source", "_source")
    if targets.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return copies(units.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # A unit of many rows is dealt in pieces of bounded size.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE).cast("long")))
    pieces = plan_mix(docs).withColumn("piece", piece)
    rows = pieces.withColumn("row", F.explode(F.sequence(F.col("piece") * PIECE + 1, F.least(F.col("n"), (F.col("piece") + 1) * PIECE))))
    taken = F.col("size") * (F.col("base") + (F.col("row") <= F.col("extra")).cast("long"))
    return rows.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def ranked_rows(rows: DataFrame) -> DataFrame:
    """`rows` (row, id, source, hash, key, ...) with `rank`, a row's place in its unit by key, from 1; no unit is gathered in one task."""
    order = ["hash", "id", "source", "key"]
    placed = rows.withColumn("place", F.pmod(F.monotonically_increasing_id(), F.lit(1024))).repartitionByRange(*order, "place")
    placed = keep(placed.drop("place").withColumn("part", F.spark_partition_id()), "contested")
    held = placed.groupBy(*UNIT, "part").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy(*UNIT).orderBy("part")) - F.col("held"))
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("part", *UNIT).orderBy("key")))
    both = own.alias("r").join(before.alias("b"), same_unit("r", "b") & (F.col("r.part") == F.col("b.part")))
    return both.select("r.*", (F.col("r.own") + F.col("b.before")).alias("rank"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """`docs` with each row as often as the mix takes it, 0, 1 or 2 times; of equal units the rows of the smallest hashes are taken once more."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mix = plan_mix(docs.select("doc_id", "source", "text")).filter("base > 0 or extra > 0").select(*UNIT, "n", "base", "extra")
    spot = docs.select(F.struct(*columns).alias("row"), *unit_columns(docs)[:3], F.xxhash64(*columns).alias("key"))
    joined = spot.alias("d").join(mix.alias("m"), same_unit("d", "m")).select("d.*", "m.n", "m.base", "m.extra")
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    plain = joined.filter(~split).select("row", (F.col("base") + (F.col("extra") > 0).cast("long")).alias("copies"))
    some = ranked_rows(joined.filter(split)).select("row", (F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")).alias("copies"))
    taken = plain.unionByName(some) if mix.filter(split).limit(1).count() else plain
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return taken.filter("copies > 0").select("row", copy).select("row.*")
