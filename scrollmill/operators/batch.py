"""Batches and stores: the tables that jobs pass on, and their schemas.

All times are ISO strings of fixed width, so they compare as text.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATIONS = "conv_key string, source_id string, source_label string, upstream_id string, title string, started_at string, updated_at string, metadata map<string,string>"
MESSAGES = "conv_key string, source_id string, ord long, upstream_id string, role string, created_at string, updated_at string, text string, thinking string, model_id string, upstream_ids array<string>, attachments array<string>, citations array<string>, media array<string>, evidence_uri string"
EVIDENCE = "conv_key string, source_id string, ord long, uri string, content string, metadata string"
DIAGNOSTICS = "source_id string, severity string, code string, message string, evidence_ref string"
#: What an import knows of its sources as a whole.
FACTS = "source_id string, label string, confidence string, confidence_reason string, cursor string, schema_fingerprint string, source_version string"

STORE = {
    "conversations": "id string, source_id string, source_label string, upstream_id string, signature string, url string, title string, started_at string, updated_at string, message_count long, evidence_refs array<string>, metadata map<string,string>",
    "messages": "message_id string, conversation_id string, source_id string, upstream_id string, role string, created_at string, updated_at string, text string, thinking string, model_id string, upstream_ids array<string>, attachments array<string>, citations array<string>, media array<string>, evidence_id string",
    "evidence": "evidence_id string, source_id string, uri string, content string, content_hash string, metadata string, created_at string",
    "diagnostics": "id string, source_id string, severity string, code string, message string, evidence_ref string, created_at string",
    "status": "source_id string, label string, health string, confidence string, confidence_reason string, last_import_at string, conversations long, messages long, evidence long, cursor string, schema_fingerprint string, source_version string",
}


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """`df` with exactly a schema's columns; absent ones are null."""
    from pyspark.sql.types import _parse_datatype_string

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(ddl).fields])


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share: under the checkpoint folder, or else, on one machine, the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_written: list[str] = []


def cut(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Cut lineage with a written table: later steps read it instead of planning and running all before them again; `options` are the writer's."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.options(**options).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """Cut several frames at once; their jobs share the cluster."""
    spark = next(iter(frames.values())).sparkSession
    with ThreadPoolExecutor(len(frames)) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(cut), df, name) for name, df in frames.items()}
        return {name: r.result() for name, r in running.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession):
    """Tables that `cut` writes inside are deleted at the end, when what was made of them is written elsewhere."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete(spark, path)
        del _written[before:]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


@dataclass
class Batch:
    """What one import of some sources yields; `ord` is a message's place in its conversation."""

    conversations: DataFrame
    messages: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame
    facts: DataFrame

    @staticmethod
    def of(conversations: DataFrame, messages: DataFrame, evidence: DataFrame | None = None, diagnostics: DataFrame | None = None, facts: DataFrame | None = None) -> Batch:
        spark = conversations.sparkSession
        return Batch(
            shaped(conversations, CONVERSATIONS),
            shaped(messages, MESSAGES),
            shaped(evidence, EVIDENCE) if evidence is not None else empty(spark, EVIDENCE),
            shaped(diagnostics, DIAGNOSTICS) if diagnostics is not None else empty(spark, DIAGNOSTICS),
            shaped(facts, FACTS) if facts is not None else empty(spark, FACTS),
        )

    def union(self, other: Batch) -> Batch:
        return Batch(*[getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)])


@dataclass
class Store:
    """The five tables."""

    conversations: DataFrame
    messages: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame
    status: DataFrame
    #: Of a store on disk: the keys under which its conversations are known (`merge.KEYS`).
    keys = None

    @staticmethod
    def new(spark: SparkSession) -> Store:
        return Store(**{name: empty(spark, ddl) for name, ddl in STORE.items()})
