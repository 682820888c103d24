"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

A first pass fills a pair of filters in each task: a document's distinct line hashes go to `once`,
and those that `once` already holds go to `twice`. Pairs merge by OR, and what both `once` filters
hold goes to `twice`. A second pass sends only lines that `twice` may hold through the shuffle, where
the keys themselves confirm the repeat and choose the smallest doc_id. A full filter only sends more.

Rows: a null or empty text is one empty line; keys under `min_chars` code points are never dropped;
rows with equal doc_id are one document here and each answered; a null doc_id counts as the largest.
An empty table gives no rows. Other columns pass through; input columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import id_last, join_hot, keep, table, with_text_columns

MIN_CHARS = 10
STRIPPED = " \t\n\x0b\x0c\r"
#: Filter bits per line, and the most bits a filter has: 32 MB, which is what is broadcast. Beyond it the filter passes more lines on.
BITS_PER_LINE, MOST_BITS, PROBES = 10, 1 << 28, 3
ADDED = ("n_lines", "n_dropped", "kept_text")
SEGMENT = 1 << 20  # bytes of a filter that merge together


def line_key(line: str) -> bytes:
    return line.strip(STRIPPED).encode("utf-8", "surrogatepass").lower()


def long_keys(text: str | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that may be dropped."""
    return {k for x in (text or "").split("\n") if len(k := line_key(x)) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars)}


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask, self.data = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8) if data is None else data

    def _at(self, hashes: np.ndarray):
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            at = (low + np.uint64(i) * high) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._at(hashes):
            np.bitwise_or.at(self.data, at, bit)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at, bit in self._at(hashes):
            out &= (self.data[at] & bit) > 0
        return out


def hashes(keys) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k) for k in keys), np.uint64)


def repeat_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The `twice` filter of all documents."""

    def fill(batches):
        import pyarrow as pa

        once, twice, any_rows = Bloom(bits), Bloom(bits), False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 512):
                own = [hashes(long_keys(t, min_chars)) for t in texts[a : a + 512]]
                values, counts = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
                twice.add(values[(counts > 1) | once.may_hold(values)])
                once.add(values)
            any_rows = any_rows or bool(texts)
        for k in range(0, bits // 8 if any_rows else 0, SEGMENT):
            parts = [x.data[k : k + SEGMENT].tobytes() for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=["segment", "once", "twice"])

    def merge(key, frame):
        import pandas as pd

        once = twice = None
        for a, b in zip(frame["once"], frame["twice"]):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pd.DataFrame([{"segment": key[0], "twice": twice.tobytes()}])

    # As many filter pairs as cores, not as files: what merges then grows with the filter alone.
    spark = docs.sparkSession
    filled = docs.select("text").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(fill, "segment long, once binary, twice binary")
    merged = keep(filled.groupBy("segment").applyInPandas(merge, "segment long, twice binary"), "bloom")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():  # MOST_BITS / 8 bytes at most in all
        part = np.frombuffer(r.twice, np.uint8)
        out[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to `docs` (doc_id, text, ...)."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(most_bits, max(1 << 16, 1 << int(lines * BITS_PER_LINE).bit_length()))
    shared = spark.sparkContext.broadcast(repeat_filter(docs, min_chars, bits))

    def suspects(batches):
        import pyarrow as pa

        twice = Bloom(bits, shared.value)
        for batch in batches:
            ids, marks, texts = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(ids), 512):
                own = [(i, m, k) for i, m, t in zip(ids[a : a + 512], marks[a : a + 512], texts[a : a + 512]) for k in long_keys(t, min_chars)]
                held = np.flatnonzero(twice.may_hold(hashes(r[2] for r in own)))
                rows = list(zip(*[own[j] for j in held])) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(r, kind) for r, kind in zip(rows, (pa.int64(), pa.int64(), pa.binary()))], names=["doc", "mark", "key"])

    # Rows of one id with other texts are told apart by a hash of the text, so that a group holds the lines of one text.
    row = [id_last("doc_id").alias("doc"), F.xxhash64("text").alias("mark")]
    suspected = keep(docs.select(*row, "text").mapInArrow(suspects, "doc long, mark long, key binary"), "suspects")
    repeated = suspected.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last").select("key", "first", "n")
    drops = join_hot(suspected, keep(repeated, "repeated"), "key", "n").filter("doc <> first").groupBy("doc", "mark").agg(F.collect_set("key").alias("drop"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    marked = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"), *row).join(drops, ["doc", "mark"], "left").select("row", "text", "drop")

    def make():
        def one(text, drop):
            parts = (text or "").split("\n")
            if not drop:
                return len(parts), 0, text or ""
            drop = set(drop)
            kept = [x for x in parts if line_key(x) not in drop]
            return len(parts), len(parts) - len(kept), "\n".join(kept)

        return lambda texts, drop: zip(*map(one, texts, drop)) if texts else [[], [], []]

    found = with_text_columns(marked, ["text", "drop"], "n_lines long, n_dropped long, kept_text string", make)
    return found.select("row.*", *ADDED)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d)
), f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, f.first IS NOT NULL AND f.first <> l.doc_id AS dropped FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
