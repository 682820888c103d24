"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `window` consecutive words of a benchmark item (or a whole item of
fewer words). The search slides a block of two words over a document: a shift table tells how
many positions no pattern can end at; where the shift is zero, the hash of that block and of the window's first
block select the test strings, and direct comparison confirms an occurrence.

Spark deals the benchmark to blocks of bounded size in the shared folder; a task loads one block at a time.

Rows: a null or empty text has no words and no hits; a null or empty item gives no pattern; a
null item_id is left out; repeated items and item_ids count once; repeated document rows are
each answered. An empty benchmark finds nothing. Other columns pass through; input columns named
like the results are replaced.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import keep, new_folder, open_store, ranges, table, with_text_columns

WINDOW = 10
#: Bytes of benchmark text whose tables a task holds at once (on average; more where one item is longer): at most some 40 bytes of tables for each.
ROUND_BYTES = 4_000_000
#: A-Z lower-cased, all other ASCII but digits and letters to a space; bytes over 0x7F are word bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """Distinct patterns of one length: `rows` of word numbers, each with the items that own it."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray):
        self.m = m = rows.shape[1]
        self.block = min(2, m)
        rows, number = np.unique(rows, axis=0, return_inverse=True)
        self.size = 1 << max(12, (len(rows) * m * 4).bit_length())
        self.shift = np.full(self.size, m - self.block + 1, np.uint8 if m < 250 else np.int32)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, self._key(rows[:, j + 1 - self.block], rows[:, j]), m - 1 - j)
        tags = self._tag(rows)
        order = np.argsort(tags, kind="stable")
        self.tags, self.rows = tags[order], rows[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owned = np.unique(np.stack([place[number.ravel()], owners], 1), axis=0)
        self.owners, self.owned = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(rows) + 1))

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table cell of a block of words a, b (of one word: a is b)."""
        return (a.astype(np.int64) * 0x9E3779B1 + b) & (self.size - 1)

    def _tag(self, rows: np.ndarray) -> np.ndarray:
        """The hashes of the last and the first block of windows."""
        m, k = self.m, self.block
        return (self._key(rows[:, m - k], rows[:, m - 1]) << 32) | self._key(rows[:, 0], rows[:, k - 1])

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, patterns) of all occurrences."""
        m, n = self.m, len(ids)
        if n < m:
            return np.zeros((2, 0), np.int64)
        k = self.block
        shifts, ends, at = self.shift[self._key(ids[: n - k + 1], ids[k - 1 :])].tolist(), [], m - k
        while at <= n - k:
            step = shifts[at]
            if not step:
                ends.append(at)
            at += step or 1
        starts = np.array(ends, np.int64) - (m - k)
        here = ids[starts[:, None] + np.arange(m)]
        tag = self._tag(here)
        low, high = np.searchsorted(self.tags, tag), np.searchsorted(self.tags, tag, "right")
        some = ranges(low, high - low)
        of = np.repeat(np.arange(len(starts)), high - low)
        same = (self.rows[some] == here[of]).all(1)
        return starts[of[same]], some[same]


class Matcher:
    """All patterns of some benchmark items, one table per pattern length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        at = {i: k for k, i in enumerate(self.items)}
        by_length: dict[int, list] = {}
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            if m := min(window, len(ids)):
                rows = np.lib.stride_tricks.sliding_window_view(ids, m)
                by_length.setdefault(m, []).append((rows, np.full(len(rows), at[item_id])))
        self.tables = [WuManber(*map(np.concatenate, zip(*found))) for _, found in sorted(by_length.items())]

    def find(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Words, merged hit spans as a flat list of starts and ends, and item ids."""
        ws = words(text)
        get = self.number.get
        ids = np.array([get(w, 0) for w in ws], np.int32)
        spans, items = [], set()
        for t in self.tables:
            starts, found = t.search(ids)
            spans += [(a, a + t.m) for a in starts.tolist()]
            for p in set(found.tolist()):
                items.update(t.owners[t.owned[p] : t.owned[p + 1]].tolist())
        return len(ws), merged(spans), sorted(self.items[k] for k in items)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, limit: int) -> tuple[str, int]:
    """Write the items in blocks of some `limit` bytes; their folder and number. Only two counts reach the driver."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).distinct()
    items = keep(items, "items")
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / limit))
    folder = new_folder(items.sparkSession, "blocks")
    items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, n


def load_block(folder: str, k: int) -> list[tuple[str, str]]:
    """Items of a block; none where it has no files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = open_store(f"{folder}/block={k}")
    files = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [row for f in sorted(files) for row in pq.ParquetFile(store.open_input_file(f)).read(columns=["i", "t"]).to_pylist()]
    return [(r["i"], r["t"]) for r in rows]


_held: dict = {}


def matcher(run: str, folder: str, k: int, window: int) -> Matcher:
    """The tables of a block; a worker holds those of one block."""
    if (run, k) not in _held:
        _held.clear()
        _held[run, k] = Matcher(load_block(folder, k), window)
    return _held[run, k]


FOUND = "n_words long, hits array<int>, items array<string>"


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Add n_words, hits (flat starts and ends of merged word spans) and items (ids whose windows occur) to `docs`.

    With one block of benchmark text the documents are not shuffled. With more, they are numbered and written once, each block is
    searched in a job of its own that writes what it finds, and the finds of a document are joined to it by its number.
    """
    folder, n = blocks(benchmark, round_bytes)
    run = uuid.uuid4().hex

    def searched(rows: DataFrame, k: int) -> DataFrame:
        def make():
            one = matcher(run, folder, k, window)
            return lambda texts: list(zip(*map(one.find, texts))) or [[], [], []]

        return with_text_columns(rows, "text", FOUND, make)

    if n == 1:
        return searched(docs, 0)
    spot = docs.drop("n_words", "hits", "items").select(F.struct("*").alias("row"), F.col("text").alias("text"))
    spot = keep(spot.withColumn("number", F.monotonically_increasing_id()), "numbered")
    every = None
    for k in range(n):
        # Block 0 gives the number of words of every document, the others only what they find.
        found = searched(spot.select("number", "text"), k).select("number", "n_words", "hits", "items")
        found = keep(found if k == 0 else found.filter(F.size("hits") > 0), "found")
        every = found if every is None else every.union(found)
    spans = F.flatten(F.collect_list(F.when(F.size("hits") > 0, F.transform(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1), lambda i: F.struct(F.get("hits", 2 * i).alias("a"), F.get("hits", 2 * i + 1).alias("b")))).otherwise(F.expr("cast(array() as array<struct<a:int,b:int>>)"))))
    whole = every.groupBy("number").agg(F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Sorted spans that overlap or touch become one.
    none = F.expr("cast(array() as array<int>)")
    step = lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1) >= s["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), s["b"])))).otherwise(F.concat(out, F.array(s["a"], s["b"])))
    whole = whole.select("number", "n_words", F.aggregate("spans", none, step).alias("hits"), "items")
    return spot.select("number", "row").join(whole, "number").select("row.*", "n_words", "hits", "items")


def n_hit():
    """Words inside the merged spans: ends less starts."""
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark window; the columns stay as they are."""
    spot = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return find_passages(spot, benchmark).filter(F.size("hits") == 0).select("row.*")


ORACLE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), bw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM win),
dpos AS (
  SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)
), occ AS (SELECT d.rid, d.i, d.m, win.item_id FROM dpos d JOIN win ON d.m = win.m AND d.p = win.p),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS k FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
