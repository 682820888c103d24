"""Readers, the source registry, and what all sources share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scrollmill.functions import variants as V
from scrollmill.functions.text import filled, is_title, session_title, title_from_text
from scrollmill.functions.times import EPOCH, iso_date
from scrollmill.operators.batch import DIAGNOSTICS, MESSAGES, Batch, cut, empty, shaped
from scrollmill.operators.windows import keep_first

SKIPPED = r"/(node_modules|\.git)/"


@dataclass(frozen=True)
class Source:
    """id, label, confidence, the path rule of its files, and read(spark, path) -> Batch; with `by_file` also of a list of files."""

    id: str
    label: str
    confidence: str
    path_rule: str
    read: Callable[[SparkSession, str | list[str]], Batch]
    by_file: bool = True


SOURCES: dict[str, Source] = {}


def register_source(id: str, label: str, confidence: str, path_rule: str, by_file: bool = True):
    def put(fn):
        SOURCES[id] = Source(id, label, confidence, path_rule, fn, by_file)
        return fn

    return put


def tolerant(spark: SparkSession) -> None:
    """The last of duplicate JSON keys counts, as in JavaScript. Logs lie in many small folders, which are listed by some tasks for each core, not one for each folder, and a task opens some hundreds of small files."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 10))


def find_files(spark: SparkSession, root: str, rule: str) -> DataFrame:
    """(path, length, modified) of files under a root whose path matches a rule; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.col("path").rlike(rule) & ~F.col("path").rlike(SKIPPED)).select("path", "length", F.col("modificationTime").alias("modified"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, length, modified) a former state does not hold: new and rewritten ones, also with an older time."""
    return files.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def files_signature(files: DataFrame) -> str:
    """One mark of a file list, from sums that no order changes: its number of files and two sums of their hashes."""
    columns = ["path", "length", F.col("modified").cast("long")]
    r = files.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")) for k in (1, 2)]).first()
    return ":".join(str(x or 0) for x in r)


def files_fingerprint(spark: SparkSession, files: DataFrame, n: int = 20, sample: int = 8192) -> str | None:
    """A hash of the first `sample` characters of the first `n` files by path; None of no files."""
    paths = [r.path for r in files.select("path").distinct().orderBy("path").limit(n).collect()]
    if not paths:
        return None
    lines = text_lines(spark, [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]).filter(F.col("line") <= sample)
    starts = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", F.substring("value", 1, sample).alias("v")))).alias("ls"))
    starts = starts.select("path", F.substring(F.array_join(F.transform("ls", lambda x: x["v"]), "\n"), 1, sample).alias("start"))
    whole = starts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "start"))), lambda x: x["start"]), "\n---\n"), 256))
    return whole.first()[0][:16]


#: Up to so many blocks of files their first line numbers are broadcast; of more they are joined by shuffle.
BROADCAST_BLOCKS = 100_000


def text_lines(spark: SparkSession, root: str | list[str], rule: str = ".*", select: str | None = None) -> DataFrame:
    """(path, line, value, modified): non-blank lines of all files with their 1-based numbers, blank lines counted.

    `select` keeps lines by a pattern. Many small files are opened once: their lines are written as a table, and all passes read that. No line is
    shuffled: a first pass counts the lines of each block of a file, whose running sums number its blocks; inside a block, which one task read in
    order, a line's number follows from the row's own.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("modified"))
    raw = cut(raw.withColumn("seq", F.monotonically_increasing_id()).filter(F.col("path").rlike(rule) & ~F.col("path").rlike(SKIPPED)), "lines")
    counted = raw.groupBy("path", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    blocks = cut(counted.select("path", "block", (before - F.col("first") + 1).alias("shift")), "blocks")
    side = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    kept = raw.filter(filled("value"))
    if select:
        kept = kept.filter(F.col("value").rlike(select))
    return kept.join(side, ["path", "block"]).select("path", (F.col("seq") + F.col("shift")).cast("int").alias("line"), "value", "modified")


def log_files(spark: SparkSession, root: str, rule: str) -> DataFrame:
    """(path) of the files under a root, without reading them."""
    return find_files(spark, root, rule).select("path")


def read_jsonl(lines: DataFrame, source_id: str, tail: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (path, line, v, uri, modified) and diagnostics from numbered lines.

    Only JSON objects are records; other lines are errors, but with `tail` a bad last line is information
    of code `<tail>_trailing_record_incomplete`.
    """
    parsed = lines.withColumn("v", V.parse("value")).withColumn("uri", F.concat("path", F.lit("#L"), F.col("line").cast("string")))
    good = V.is_object("v")
    records = parsed.filter(good).select("path", "line", "v", "uri", "modified")
    bad = parsed.filter(~good)
    if tail:  # only bad lines meet their file's last line
        bad = bad.join(lines.groupBy("path").agg(F.max("line").alias("last")), "path")
    cut = (F.col("line") == F.col("last")) if tail else F.lit(False)
    diagnostics = bad.select(
        F.lit(source_id).alias("source_id"),
        F.when(cut, "info").otherwise("error").alias("severity"),
        F.when(cut, f"{tail}_trailing_record_incomplete").otherwise("jsonl_malformed").alias("code"),
        F.when(cut, "The last record is not complete yet.").otherwise("A line is not a JSON object.").alias("message"),
        F.col("uri").alias("evidence_ref"),
    )
    return records, diagnostics


def per_session(rows: DataFrame, order: list[str], one: Callable[[object, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The tuples that `one(key, group)` gives for the rows of each key, the first column; a group is a list of tuples of the other columns in `order`.

    Sessions are many and small: those of a task run one after another over its Arrow batches, and all cores take part, however few bytes the rows have.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    kinds = [f.type for f in to_arrow_schema(T._parse_datatype_string(schema))]

    def run(batches):
        import pyarrow as pa

        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)
        found = []
        for key, group in groupby((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), key=itemgetter(0)):
            found += one(key, [r[1:] for r in group])
            if len(found) >= 10_000:
                yield pack(found)
                found = []
        yield pack(found)

    key = rows.columns[0]
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def read_objects(spark: SparkSession, root: str, rule: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file: (path, v) and an error for each other file. The files are opened once."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    files = cut(files.filter(F.col("path").rlike(rule)), "objects").withColumn("v", V.parse("value"))
    bad = files.filter(~V.is_object("v"))
    return files.filter(V.is_object("v")).select("path", "v"), diagnostic(bad, source_id, "error", "source_unreadable", "A file does not hold a JSON object.", "path")


def diagnostic(rows: DataFrame, source_id: str, severity: str, code: str, message, ref: str | Column) -> DataFrame:
    ref = F.col(ref) if isinstance(ref, str) else ref
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(source_id).alias("source_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.cast("string").alias("message"), ref.alias("evidence_ref"))


def record_time(v="v") -> Column:
    """timestamp, createdAt or created_at of a record: a number is milliseconds, text a date, else the epoch; each step is evaluated once."""
    first = F.coalesce(V.get(v, "$.timestamp"), V.get(v, "$.createdAt"), V.get(v, "$.created_at"))
    told = F.transform(F.array(first), lambda x: F.struct(V.number(x).alias("n"), V.string(x).alias("s")))
    return F.get(F.transform(told, lambda x: iso_date(x["n"], F.when((F.length(x["s"]) >= 10) & ~x["s"].rlike(r"^\d+$"), x["s"]), EPOCH)), 0)


def json_date(v: Column, fallback=EPOCH) -> Column:
    """A JSON number or string as an ISO time, else the fallback."""
    return F.coalesce(iso_date(V.number(v), V.string(v), None), fallback if isinstance(fallback, Column) else F.lit(fallback))


def dedup(messages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The first message of each (role, time, text) in a conversation; the shuffle key is a hash of the text."""
    keyed = messages.withColumn("_h", F.sha2("text", 256))
    return settle(keep_first(keyed, ["conv_key", *extra, "role", "created_at", "_h"], "ord").drop("_h"))


def settle(messages: DataFrame) -> DataFrame:
    """Messages written once: titles, times and empty sessions are found from them without another pass over the logs."""
    return cut(messages, "messages")


def sessions(messages: DataFrame) -> DataFrame:
    """(conv_key, started, updated, n, user_title, any_title, first_user, first_text, first_time, last_time)."""
    fit = is_title("text")
    return messages.groupBy("conv_key").agg(
        F.min("created_at").alias("started"),
        F.max("created_at").alias("updated"),
        F.count("*").alias("n"),
        F.min_by("text", F.when(fit & (F.col("role") == "user"), F.col("ord"))).alias("user_title"),
        F.min_by("text", F.when(fit, F.col("ord"))).alias("any_title"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("ord"))).alias("first_user"),
        F.min_by("text", "ord").alias("first_text"),
        F.min_by("created_at", "ord").alias("first_time"),
        F.max_by("created_at", "ord").alias("last_time"),
    )


def best_title(fallback, *preferred) -> Column:
    """The first fitting title among some columns, then the sessions' own, else the fallback."""
    found = F.coalesce(*[F.when(is_title(p), F.col(p) if isinstance(p, str) else p) for p in preferred], F.col("user_title"), F.col("any_title"), F.lit(""))
    return title_from_text(found, fallback)


def first_titles(side: DataFrame) -> DataFrame:
    """(session_key, side_title): of (session_key, ord, title) the first fitting one."""
    return side.filter(is_title("title")).groupBy("session_key").agg(F.min_by("title", "ord").alias("side_title"))


def finish(source_id: str, label: str, conversations: DataFrame, messages: DataFrame, diagnostics: list[DataFrame]) -> Batch:
    """A batch with the source's names; conversations have conv_key, upstream_id, title, started_at, updated_at, metadata."""
    from functools import reduce

    spark = conversations.sparkSession
    every = reduce(DataFrame.unionByName, [shaped(d, DIAGNOSTICS) for d in diagnostics], empty(spark, DIAGNOSTICS))
    named = conversations.withColumn("source_id", F.lit(source_id)).withColumn("source_label", F.lit(label))
    placed = messages.withColumn("source_id", F.lit(source_id))
    key = F.concat(F.lit(source_id + "\x1f"), F.col("conv_key"))
    return Batch.of(named.withColumn("conv_key", key), shaped(placed, MESSAGES).withColumn("conv_key", key), None, every)


def metadata(**values) -> Column:
    """A map of text; null values are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def split_empty(sessions_: DataFrame, messages: DataFrame, source_id: str, code: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Sessions (conv_key, ...) that have messages, and a warning for each that has none."""
    keys = messages.select("conv_key").distinct()
    return sessions_.join(keys, "conv_key", "left_semi"), diagnostic(sessions_.join(keys, "conv_key", "left_anti"), source_id, "warning", code, "The session had records but no importable messages.", ref)


def unmapped(records: DataFrame, source_id: str, code: str, ref: str) -> DataFrame:
    """One row per group of `ref` that says how many records were skipped."""
    counts = records.groupBy(ref).agg(F.count("*").alias("n"))
    return diagnostic(counts, source_id, "info", code, F.concat(F.col("n").cast("string"), F.lit(" events were skipped because they did not contain importable messages.")), ref)


def fingerprint(records: DataFrame, group: str, sample: int = 20) -> DataFrame:
    """(group, fingerprint): a hash of the sorted key shapes of each group's first records by line."""
    from scrollmill.operators.windows import top_n

    some = top_n(records, [group], ["line"], sample, "_n")
    shapes = some.select(group, V.kind("v").alias("shape"))
    return shapes.groupBy(group).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("shape")), "\x1f"), 256), 1, 16).alias("fingerprint"))


def parent(path) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"/[^/]*$", "")


__all__ = [n for n in dir() if not n.startswith("_")]
