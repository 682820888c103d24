"""Importing what changed: one pass over registered sources, to be run on a trigger or before a query."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill import sources as _sources  # noqa: F401
from scrollmill.operators import export
from scrollmill.operators.batch import FACTS, Store, delete, empty, temporary
from scrollmill.operators.merge import Change, apply_change, merge_change
from scrollmill.operators.status import mark_absent, summarize_diagnostics
from scrollmill.sources.base import SOURCES, Source, changed_files, files_fingerprint, find_files

INTERVAL_SECONDS = 30
#: Up to so many changed files are named to the reader; of more, the folder is read whole.
MOST_FILES = 10_000
STATE = "source_id string, path string, length long, modified timestamp"
#: The log of looks: files that a look found new or rewritten, or gone; a row without a path marks the look itself.
LOG = STATE + ", gone boolean"
#: After so many looks the log is written whole and older ones go.
MOST_LOOKS = 32


REPORT = "source_id string, changed_conversations long, changed_messages long, skipped_records long"


@dataclass(frozen=True)
class Spec:
    """A source id, the folder of its files, and what else its reader takes (folders of sidecars by their names)."""

    source_id: str
    root: str
    options: dict = field(default_factory=dict)


def literal(path: str) -> str:
    """A path whose signs are not taken for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def look(spark: SparkSession, spec: Spec) -> DataFrame | None:
    """The files of a source by its path rule, or None where there are none."""
    try:
        files = find_files(spark, spec.root, SOURCES[spec.source_id].path_rule)
        return files if files.limit(1).count() else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def facts_of(spark: SparkSession, source: Source, files: DataFrame) -> DataFrame:
    """What the status says of a source: label, confidence, why, and the fingerprint of its files."""
    n = files.count()
    row = (source.id, source.label, source.confidence, f"{n} file{'' if n == 1 else 's'} matched the source's path rule.", None, files_fingerprint(spark, files), None)
    return spark.createDataFrame([row], FACTS)


@dataclass
class Imported:
    """One source's import: its change (None: nothing to do), the files it has, and what the report says."""

    change: Change | None
    files: DataFrame | None
    report: tuple


def import_source(spark: SparkSession, store: Store, spec: Spec, at: str, skip_unchanged: bool = False, known: DataFrame | None = None) -> Imported:
    """Merge one source's new or rewritten files into a store (all its files unless `skip_unchanged`).

    An absent source changes its status row alone, and that only when it is not absent already.
    """
    source, none = SOURCES[spec.source_id], (spec.source_id, 0, 0, 0)
    files = look(spark, spec)
    if files is None:
        if store.status.filter((F.col("source_id") == source.id) & (F.col("health") == "absent")).limit(1).count():
            return Imported(None, None, none)
        status = mark_absent(store.status, source.id, source.label, source.confidence, "No file matched the source's path rule.")
        nothing = Store.new(spark)
        change = Change(nothing.conversations, nothing.messages, empty(spark, "id string"), nothing.evidence, nothing.diagnostics, empty(spark, "source_id string"), status)
        return Imported(change, None, none)
    own = files.withColumn("source_id", F.lit(spec.source_id))
    before = known.filter(F.col("source_id") == spec.source_id) if known is not None else None
    where: str | list[str] = spec.root
    scope = "full"
    if skip_unchanged:
        scope = "partial"
        if before is not None:
            changed = [r.path for r in changed_files(files, before).select("path").limit(MOST_FILES + 1).collect()]
            if not changed:
                return Imported(None, own, none)
            if source.by_file and len(changed) <= MOST_FILES:
                where = [literal(p) for p in sorted(changed)]
    batch = source.read(spark, where, **spec.options)
    batch = replace(batch, diagnostics=summarize_diagnostics(batch.diagnostics), facts=facts_of(spark, source, files))
    change = merge_change(store, batch, scope, at)
    n, m = change.conversations.count(), change.messages.count()
    return Imported(change, own, (spec.source_id, n, m, 0))


def import_sources(spark: SparkSession, store: Store, specs: list[Spec], at: str, skip_unchanged: bool = False, known: DataFrame | None = None) -> tuple[Store, DataFrame | None]:
    """Merge all specs into a store, one batch per source; returns it and the file state (source_id, path, length, modified).

    With `skip_unchanged`, sources without new or rewritten files are left alone, and others are merged as partial;
    those that can be read file by file are read in their changed files only.
    """
    store, state, _ = import_all(spark, store, specs, at, skip_unchanged, known)
    return store, state


def import_all(spark: SparkSession, store: Store, specs: list[Spec], at: str, skip_unchanged: bool = False, known: DataFrame | None = None, put=None) -> tuple[Store, DataFrame | None, DataFrame]:
    """`import_sources` with a report (source_id, changed_conversations, changed_messages, skipped_records); `put(change)` stores a
    change and gives the store after it."""
    put = put or (lambda change: apply_change(store, change))
    state, told = None, []
    for spec in specs:
        done = import_source(spark, store, spec, at, skip_unchanged, known)
        if done.files is not None:
            state = done.files if state is None else state.unionByName(done.files)
        if done.change is not None:
            store = put(done.change)
        told.append(done.report)
    return store, state, spark.createDataFrame(told, REPORT)


def refresh(spark: SparkSession, store_dir: str, specs: list[Spec], at: str, interval: float = INTERVAL_SECONDS, now: float | None = None) -> Store:
    """What a query calls first: the stored tables, with changed files merged unless the last look is under `interval` seconds old.

    The file state lies beside the store as a log, one partition a look with what that found changed. The store is written before it, so
    that a look that fails in between is repeated, which changes nothing. A look that finds nothing new writes no version of the store, and one row.
    """
    now = time.time() if now is None else now
    store = export.read_store(spark, store_dir) if export.exists(spark, f"{store_dir}/manifest") else None
    looks = stored(lambda: spark.read.schema(LOG + ", looked long").parquet(f"{store_dir}/files"))
    last = looks.agg(F.max("looked")).first()[0] if looks is not None and store is not None else None
    if last is not None and now * 1000 - last < interval * 1000:
        return store
    known = known_files(looks) if last is not None else None

    def put(change: Change) -> Store:
        export.write_change(change, store_dir)
        return export.read_store(spark, store_dir)

    with temporary(spark):
        after, state, _ = import_all(spark, store if store is not None else Store.new(spark), specs, at, last is not None, known, put)
        if state is not None:
            log_look(spark, f"{store_dir}/files", known, state.select("source_id", "path", "length", "modified"), int(now * 1000))
    return after


def known_files(looks: DataFrame) -> DataFrame:
    """The files that a log of looks leaves: the latest row of each path, unless that is gone."""
    latest = looks.filter("path is not null").groupBy("source_id", "path").agg(F.max_by(F.struct("length", "modified", "gone"), "looked").alias("x"))
    return latest.filter("not x.gone").select("source_id", "path", "x.length", "x.modified")


def log_look(spark: SparkSession, folder: str, known: DataFrame | None, state: DataFrame, at: int) -> None:
    """Write what a look changes: rows of new or rewritten files, of files that are gone, and the look's own."""
    mark = spark.createDataFrame([(None, None, None, None, False)], LOG)
    before = sorted(r.looked for r in spark.read.parquet(folder).select("looked").distinct().collect()) if known is not None else []  # MOST_LOOKS at most
    rows = state.withColumn("gone", F.lit(False))
    if known is not None and len(before) < MOST_LOOKS:
        gone = known.join(state, ["source_id", "path"], "left_anti").withColumn("gone", F.lit(True))
        rows = rows.join(known, ["source_id", "path", "length", "modified"], "left_anti").select(rows.columns).unionByName(gone)
    rows.unionByName(mark).write.mode("overwrite").parquet(f"{folder}/looked={at}")
    if len(before) >= MOST_LOOKS:
        for old in before:  # the oldest first: what is gone stays gone if this stops half-way
            delete(spark, f"{folder}/looked={old}")


def stored(read):
    """What `read` gives, or None where its folder is not there yet."""
    try:
        return read()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
