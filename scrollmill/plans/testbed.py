"""The given tables as a conversation store, in Spark and as SQL for the oracle.

A conv_id is a session of one of three sources, its turns are messages a minute apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.functions.ids import content_hash, message_id, stable_id
from scrollmill.functions.text import title_from_text
from scrollmill.functions.times import iso
from scrollmill.operators.batch import MESSAGES, Batch, shaped

REGISTRY: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame with its oracle."""

    def put(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCES = ("src-a", "src-b", "src-c")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with source_id, upstream ids and times."""
    t = table(spark, sf_dir, "conversations")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("conv_id") % 3 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return t.withColumn("source_id", source).withColumn("session", F.concat(F.lit("session-"), F.col("conv_id").cast("string"))).withColumn("created_at", iso(at))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    t = t.withColumn("conversation_id", stable_id("conv", "source_id", F.lit("upstreamId"), "session")).withColumn("upstream_id", F.concat(F.lit("m"), F.col("turn").cast("string"))).withColumn("thinking", F.lit(None).cast("string")).withColumn("idx", F.col("turn"))
    return t.withColumn("message_id", message_id(upstream_or_title="session"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    users = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    g = m.groupBy(F.col("conversation_id").alias("id"), "source_id", F.col("session").alias("upstream_id")).agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("message_count"), users.alias("first_user"))
    return g.withColumn("title", title_from_text("first_user", F.col("upstream_id"))).drop("first_user")


def batch(spark: SparkSession, sf_dir: str, keep=None, newer: int = 0) -> Batch:
    """The turns as an import batch; `keep` filters them, `newer` shifts their update time in hours."""
    t = turns(spark, sf_dir)
    t = t.filter(keep) if keep is not None else t
    m = shaped(t.select(F.col("session").alias("conv_key"), "source_id", F.col("turn").alias("ord"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("upstream_id"), "role", "created_at", "text"), MESSAGES)
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("ord")))
    c = m.groupBy("conv_key", "source_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("u"), first.alias("first_user"))
    c = c.withColumn("upstream_id", F.col("conv_key")).withColumn("source_label", F.upper("source_id")).withColumn("title", title_from_text("first_user", F.col("conv_key"))).withColumn("updated_at", iso(F.col("u").cast("timestamp") + F.make_interval(hours=F.lit(newer))))
    return Batch.of(c, m)


#: The same as CTEs: m (messages) and c (conversations).
STORE_SQL = r"""
m AS (
  SELECT *, 'msg_' || substr(sha256(conversation_id || chr(31) || source_id || chr(31) || session || chr(31) || 'm' || turn || chr(31) || created_at || CASE WHEN text <> '' THEN chr(31) || text ELSE '' END), 1, 24) AS message_id
  FROM (
    SELECT conv_id, turn, role, text, (['src-a', 'src-b', 'src-c'])[1 + conv_id % 3] AS source_id, 'session-' || conv_id AS session,
           strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
           'conv_' || substr(sha256((['src-a', 'src-b', 'src-c'])[1 + conv_id % 3] || chr(31) || 'upstreamId' || chr(31) || 'session-' || conv_id), 1, 24) AS conversation_id
    FROM conversations
  )
), cu AS (
  SELECT conversation_id AS id, source_id, session AS upstream_id, min(created_at) AS started_at, max(created_at) AS updated_at, count(*) AS message_count,
         trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\s+', ' ', 'g')) AS t
  FROM m GROUP BY ALL
), c AS (
  SELECT id, source_id, upstream_id, started_at, updated_at, message_count,
         CASE WHEN t = '' THEN upstream_id WHEN length(t) > 72 THEN substr(t, 1, 69) || '...' ELSE t END AS title FROM cu
)
"""


def documents_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one-message conversations: message_id, conversation_id, title, text, thinking."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(key.alias("message_id"), key.alias("conversation_id"), F.lit("").alias("title"), "text", F.lit(None).cast("string").alias("thinking"), iso(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("created_at"))


#: Ranked and substring queries over `documents`.
QUERIES = ("the", "thing", "idiot", "clown the", "of-the", "der", "verkeit", "que la", "licensed under", "apache license", "éeaux", "ción", "zzzz", "!!!", "thing whbleat", "password", "akia", "the thing and", "in-the", "GNU general")


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
