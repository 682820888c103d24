"""Relational dumps: session, message, part, workspace and project tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.functions.text import title_from_text, trimmed
from scrollmill.functions.times import EPOCH, iso_date
from scrollmill.operators.batch import DIAGNOSTICS, Batch, empty
from scrollmill.operators.windows import keep_first
from scrollmill.sources import base as S

ID, LABEL = "opencode", "OpenCode"
TABLES = ("session", "message", "part", "workspace", "project")
IDS = ("id", "uuid", "session_id", "sessionID")


def first(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-blank of some columns that a table has."""
    found = [F.when(trimmed(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def time_of(df: DataFrame, *names: str) -> Column:
    """The first of some columns that a table has, as an ISO time."""
    has = next((n for n in names if n in df.columns), None)
    if has is None:
        return F.lit(None).cast("string")
    return F.when(F.col(has).isNull(), EPOCH).otherwise(iso_date(F.lit(None), F.col(has).cast("string"), EPOCH))


def from_relational(spark: SparkSession, tables: dict[str, DataFrame], path: str = "") -> Batch:
    """`tables` may lack all but session and message; a column `ord` keeps the rows' order."""
    if "session" not in tables or "message" not in tables:
        none = empty(spark, "conv_key string, upstream_id string, title string, started_at string, updated_at string, metadata map<string,string>")
        error = spark.createDataFrame([(ID, "error", "opencode_schema_unsupported", "The session or message table is missing.", path)], DIAGNOSTICS)
        return S.finish(ID, LABEL, none, empty(spark, "conv_key string, ord long, upstream_id string, role string, created_at string, text string"), [error])
    session, message = tables["session"], tables["message"]
    s = session.withColumn("conv_key", F.coalesce(first(session, IDS), F.lit("unknown-session")))
    m = message.select(first(message, ("session_id", "sessionID", "session")).alias("conv_key"), first(message, IDS).alias("mid"), F.col("ord") if "ord" in message.columns else F.monotonically_increasing_id().alias("ord"), first(message, ("content", "text")).alias("own"), first(message, ("role", "type")).alias("named"), time_of(message, "created_at", "createdAt", "time", "timestamp").alias("at")).filter("conv_key is not null")
    if "part" in tables:
        part = tables["part"]
        p = part.select(first(part, ("message_id", "messageID", "message")).alias("mid"), F.col("ord").alias("k") if "ord" in part.columns else F.monotonically_increasing_id().alias("k"), first(part, ("text", "content")).alias("t")).filter("mid is not null and t is not null")
        joined = p.groupBy("mid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("parts"))
        m = m.join(joined, "mid", "left")
    else:
        m = m.withColumn("parts", F.lit(None).cast("string"))
    index = F.row_number().over(S.Window.partitionBy("conv_key").orderBy("ord"))
    m = m.withColumn("upstream_id", F.coalesce("mid", F.concat(F.lit("message-"), index.cast("string"))))
    text = F.coalesce("own", F.nullif(trimmed("parts"), F.lit("")))
    every = m.select("conv_key", F.col("ord").cast("long").alias("ord"), "upstream_id", F.when(F.col("named").isin("user", "assistant", "system", "tool"), F.col("named")).otherwise("unknown").alias("role"), F.coalesce("at", F.lit(EPOCH)).alias("created_at"), text.alias("text")).filter("text is not null")
    s = s.withColumn("ref", F.concat(F.lit(f"{path}#session="), "conv_key"))
    kept, none = S.split_empty(s, every, ID, "opencode_no_messages", "ref")

    def linked(name: str) -> DataFrame:
        if name not in tables:
            return spark.createDataFrame([], f"{name}_key string, {name}_dir string")
        rows = tables[name]
        rows = rows.select(first(rows, IDS).alias(f"{name}_key"), first(rows, ("directory", "path")).alias(f"{name}_dir"), (F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()).alias("o")).filter(f"{name}_key is not null")
        return keep_first(rows, [f"{name}_key"], "o").drop("o")

    done = kept.withColumn("workspace_key", first(session, ("workspace_id", "workspaceID", "workspace"))).withColumn("project_key", first(session, ("project_id", "projectID", "project")))
    done = done.join(S.sessions(every), "conv_key").join(linked("workspace"), "workspace_key", "left").join(linked("project"), "project_key", "left")
    updated = F.coalesce(time_of(session, "updated_at", "updatedAt", "lastMessageDate", "time", "created"), F.col("last_time"))
    title = title_from_text(F.coalesce(first(session, ("title", "name")), F.col("first_user"), F.lit("")), F.concat(F.lit(LABEL + " "), F.col("conv_key")))
    conversations = done.select("conv_key", F.col("conv_key").alias("upstream_id"), title.alias("title"), F.col("first_time").alias("started_at"), updated.alias("updated_at"), S.metadata(sourcePath=path, workspaceDirectory=F.col("workspace_dir"), projectDirectory=F.col("project_dir")).alias("metadata"))
    return S.finish(ID, LABEL, conversations, S.dedup(every), [none])


@S.register_source(ID, LABEL, "experimental", r"/(session|message|part|workspace|project)\.parquet", by_file=False)
def read(spark: SparkSession, root: str) -> Batch:
    """The tables as Parquet folders `<root>/<table>.parquet`; absent ones are left out."""
    found = {}
    jvm = spark.sparkContext._jvm
    for name in TABLES:
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            found[name] = spark.read.parquet(f"{root}/{name}.parquet")
    return from_relational(spark, found, root)
