"""Store on disk, snapshots and nested backups.

A store folder holds numbered versions. The manifest of a version lists its parts: a first part with whole tables and
later ones with what a merge changed, so a merge writes the conversations it touches and no others. A row counts
unless a later part holds or removes its conversation (evidence and diagnostics: clears its source).

Parts are merged by size: as long as a part is no larger than all after it, these become one part, their keys and index with them.
So a store of n rows has some log2(n) parts, and a row is written again as often.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.operators.batch import STORE, Store, delete, empty, exists
from scrollmill.operators.windows import keep_first

PARTITIONED = ("conversations", "messages", "evidence")
#: Tables beside a part's own: the keys that find its conversations, and its size in rows.
KEYS = "bucket int, source_id string, kind string, key string, id string, updated_at string"
#: Up to so many touched conversations are broadcast to a read; of more they are joined by shuffle.
BROADCAST_TOUCHED = 200_000
BACKUP = {"format": "scrollmill.backup", "schema_version": 1}


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(number, parts) of all versions; PATH_NOT_FOUND where there is no store."""
    return spark.read.schema("parts array<string>, number long").parquet(f"{path}/manifest")


def latest_number(spark: SparkSession, path: str) -> int | None:
    return manifests(spark, path).agg(F.max("number")).first()[0] if exists(spark, f"{path}/manifest") else None


def parts_of(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The parts of a version (the latest), first to last."""
    rows = manifests(spark, path)
    number = latest_number(spark, path) if version is None else int(version)
    return rows.filter(F.col("number") == number).first().parts


def write_part(spark: SparkSession, path: str, tables: dict[str, DataFrame], before: list[str]) -> int:
    """Write tables as a part, then name it in a new manifest: readers see all of it or none. A second writer of the same number fails."""
    number = (latest_number(spark, path) or 0) + 1
    part = f"part-{number:012d}-{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame) -> None:
        # Messages of a conversation lie side by side in a file, so that who asks for some conversations skips the pages of others.
        writer = (df.sortWithinPartitions("source_id", "conversation_id", "message_id") if name == "messages" else df).write
        (writer.partitionBy("source_id") if name in PARTITIONED else writer).parquet(f"{path}/{part}/{name}")

    with ThreadPoolExecutor(len(tables)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(put), *item) for item in tables.items()]:
            done.result()
    spark.createDataFrame([([*before, part],)], "parts array<string>").coalesce(1).write.parquet(f"{path}/manifest/number={number}")
    return number


def by_bucket(keys: DataFrame) -> DataFrame:
    """Keys in files sorted by bucket, so that a probe skips what it does not ask for."""
    return keys.repartitionByRange("bucket").sortWithinPartitions("bucket", "key")


def write_store(store: Store, path: str) -> int:
    """Write all tables as a new version; its number."""
    from scrollmill.operators.merge import stored_keys

    tables = {f.name: getattr(store, f.name) for f in fields(store)}
    return write_part(store.conversations.sparkSession, path, tables | {"keys": by_bucket(stored_keys(store.conversations))}, [])


def write_change(change, path: str) -> int:
    """Write what a merge changed as a new version after the latest, and merge parts by size; its number."""
    spark = change.conversations.sparkSession
    parts = parts_of(spark, path) if latest_number(spark, path) is not None else []
    number = write_part(spark, path, {n: getattr(change, n) for n in [*STORE, "gone", "cleared"]} | {"keys": by_bucket(change.keys)}, parts)
    parts = parts_of(spark, path, number)
    while (some := to_merge([part_rows(spark, path, p) for p in parts])) > 1:
        number = merge_parts(spark, path, parts, some)
        parts = parts_of(spark, path, number)
    return number


def part_rows(spark: SparkSession, path: str, part: str) -> int:
    """Messages and evidence of a part; Parquet answers from the files' footers."""
    return sum(read_part(spark, path, part, t).count() for t in ("messages", "evidence"))


def to_merge(sizes: list[int]) -> int:
    """How many of the last parts are to become one: from the first that is no larger than all after it."""
    after = 0
    most = 1
    for n, size in enumerate(reversed(sizes), 1):
        if n > 1 and size <= after:
            most = n
        after += size
    return most


def merge_parts(spark: SparkSession, path: str, parts: list[str], some: int) -> int:
    """A new version whose last `some` parts are one; rows that count, ids that go, and the index where one of them has it."""
    from scrollmill.operators.search import index_part, merged_blocks

    before, run = parts[:-some], parts[-some:]
    tables = {t: latest(spark, path, run, t, STORE[t], key) for t, key in (("conversations", "id"), ("messages", "conversation_id"))}
    tables |= {t: uncleared(spark, path, run, t) for t in ("evidence", "diagnostics")}
    tables["diagnostics"] = keep_first(tables["diagnostics"], ["id"], [F.col("created_at").desc()])
    tables = {t: df.select(*read_columns(t)) for t, df in tables.items()} | {"status": read_part(spark, path, run[-1], "status"), "keys": by_bucket(latest(spark, path, run, "keys", KEYS, "id"))}
    if before:
        gone = numbered(spark, path, run, "gone", "id string").select("id").distinct()
        tables |= {"gone": gone.join(tables["conversations"].select("id"), "id", "left_anti"), "cleared": numbered(spark, path, run, "cleared", "source_id string").select("source_id").distinct()}
    if any(exists(spark, f"{path}/{p}/index/_SUCCESS") for p in run):
        for part in run:
            index_part(spark, path, part)
        tables["index"] = merged_blocks(spark, path, run)
    return write_part(spark, path, tables, before)


def read_part(spark: SparkSession, path: str, part: str, table: str, ddl: str | None = None) -> DataFrame:
    """A table of one part; empty where the part has no such table."""
    ddl = ddl or STORE[table]
    return spark.read.schema(ddl).parquet(f"{path}/{part}/{table}") if exists(spark, f"{path}/{part}/{table}") else empty(spark, ddl)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_TOUCHED + 1).count() <= BROADCAST_TOUCHED else df


def numbered(spark: SparkSession, path: str, parts: list[str], table: str, ddl: str) -> DataFrame:
    """The rows of a table in all parts, with `part_no`."""
    out = None
    for k, part in enumerate(parts):
        own = read_part(spark, path, part, table, ddl).withColumn("part_no", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def outdated(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """(part_no, conversation_id): what later parts hold or remove of conversations, for every part before them; for an index's dead rows."""
    touched = touches(spark, path, parts).withColumnRenamed("id", "conversation_id")
    return small(touched.select("conversation_id", F.explode(F.sequence(F.lit(0), F.col("touched") - 1)).alias("part_no")))


def touches(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """(id, touched): the last of the later parts that holds or removes a conversation."""
    ids = numbered(spark, path, parts[1:], "conversations", STORE["conversations"]).select("id", "part_no").union(numbered(spark, path, parts[1:], "gone", "id string").select("id", "part_no"))
    return ids.groupBy("id").agg((F.max("part_no") + 1).alias("touched"))


def latest(spark: SparkSession, path: str, parts: list[str], table: str, ddl: str, key: str) -> DataFrame:
    """The rows of a table that count: those whose conversation (`key`) no later part holds or removes."""
    rows = numbered(spark, path, parts, table, ddl)
    if len(parts) == 1:
        return rows.drop("part_no")
    touched = small(touches(spark, path, parts).withColumnRenamed("id", key))
    return rows.join(touched, key, "left").filter("touched is null or touched = part_no").drop("touched", "part_no")


def uncleared(spark: SparkSession, path: str, parts: list[str], table: str) -> DataFrame:
    """The rows of a table that no later part clears by their source."""
    rows = numbered(spark, path, parts, table, STORE[table])
    if len(parts) == 1:
        return rows.drop("part_no")
    cleared = numbered(spark, path, parts[1:], "cleared", "source_id string").groupBy("source_id").agg((F.max("part_no") + 1).alias("cleared"))
    return rows.join(small(cleared), "source_id", "left").filter("cleared is null or cleared <= part_no").drop("cleared", "part_no")


def read_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """The latest version of a store (or a given one)."""
    parts = parts_of(spark, path, version)
    by_id = {t: latest(spark, path, parts, t, STORE[t], key).select(*read_columns(t)) for t, key in (("conversations", "id"), ("messages", "conversation_id"))}
    diagnostics = uncleared(spark, path, parts, "diagnostics").select(*read_columns("diagnostics"))
    if len(parts) > 1:
        diagnostics = keep_first(diagnostics, ["id"], [F.col("created_at").desc()])
    store = Store(by_id["conversations"], by_id["messages"], uncleared(spark, path, parts, "evidence").select(*read_columns("evidence")), diagnostics, read_part(spark, path, parts[-1], "status"))
    store.keys = latest(spark, path, parts, "keys", KEYS, "id")
    return store


def read_columns(table: str) -> list[str]:
    return [c.split()[0] for c in STORE[table].replace("map<string,string>", "map").split(", ")]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the manifests of all but the newest versions and the parts that only they list; the parts deleted."""
    rows = sorted(((r.number, r.parts) for r in manifests(spark, path).collect()), reverse=True)  # a row for each version
    live = {p for _, parts in rows[:keep] for p in parts}
    dead = sorted({p for _, parts in rows[keep:] for p in parts} - live)
    for number, _ in rows[keep:]:
        delete(spark, f"{path}/manifest/number={number}")
    for part in dead:
        delete(spark, f"{path}/{part}")
    return dead


def write_snapshot(store: Store, path: str) -> DataFrame:
    """A full copy of the five tables; returns its counts."""
    for f in fields(store):
        getattr(store, f.name).write.mode("error").parquet(f"{path}/{f.name}")
    return backup_counts(store)


def nest_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their messages as a sorted array; one shuffle by conversation."""
    body = [c for c in messages.columns if c not in ("conversation_id", "source_id", "created_at", "message_id")]
    nested = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "message_id", *body))).alias("messages"))
    return conversations.join(nested.withColumnRenamed("conversation_id", "id"), "id", "left")


def table_mark(df: DataFrame) -> str:
    """SHA-256 over order-free sums of two hashes of all rows, and their number."""
    cells = [F.to_json(F.struct("*"))]
    r = df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), *cells).cast("decimal(38,0)")) for k in (1, 2)]).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit("/".join(str(x or 0) for x in r)), 256)).first()[0]


def backup_counts(store: Store) -> DataFrame:
    """One row: counts of the five tables, and a SHA-256 of their contents that no order of rows changes."""
    spark = store.conversations.sparkSession
    counts = {f.name: getattr(store, f.name).count() for f in fields(store)}
    marks = ",".join(f"{f.name}:{table_mark(getattr(store, f.name))}" for f in fields(store))
    return spark.createDataFrame([(*counts.values(), marks)], ", ".join(f"{n} long" for n in counts) + ", marks string").select(*counts, F.sha2("marks", 256).alias("checksum"))


def write_backup(store: Store, path: str, exported_at: str, fmt: str = "json") -> DataFrame:
    """A backup in sharded JSON lines, or a table snapshot; returns its counts.

    The shards of `conversations` (each with its messages) are ranges by falling time, so they read newest first in order of
    their names; evidence is in order of (created_at, id), diagnostics by falling time. `header` has the format, its version,
    the time, the counts and the checksum, `sources` the status of all sources.
    """
    if fmt == "snapshot":
        return write_snapshot(store, path)
    if fmt != "json":
        raise ValueError("a backup is json or snapshot")

    def put(rows: DataFrame, name: str, *order) -> None:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(f"{path}/{name}")

    put(nest_conversations(store.conversations, store.messages), "conversations", F.col("updated_at").desc(), F.col("id"))
    put(store.evidence, "evidence", F.col("created_at"), F.col("evidence_id"))
    put(store.diagnostics, "diagnostics", F.col("created_at").desc(), F.col("id"))
    put(store.status, "sources", F.col("source_id"))
    counts = backup_counts(store)
    header = {**BACKUP, "exported_at": exported_at}
    counts.select(*[F.lit(v).alias(k) for k, v in header.items()], "*").coalesce(1).write.json(f"{path}/header")
    return counts
