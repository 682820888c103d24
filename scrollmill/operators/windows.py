"""Keep-first de-duplication, best candidates, message windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str | list) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates has none)."""
    orders = [order] if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank; Spark prunes groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def message_windows(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Messages around anchors (conversation_id, message_id, context 0 to 5), in (created_at, message_id) order.

    Only anchored conversations are read past the semi-join. Anchors that do not exist give no rows.
    """
    some = messages.join(anchors.select("conversation_id").distinct(), "conversation_id", "left_semi")
    order = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    numbered = some.withColumn("rn", F.row_number().over(order))
    places = numbered.select("conversation_id", "message_id", F.col("rn").alias("at"))
    asked = anchors.join(places, ["conversation_id", "message_id"]).select("conversation_id", F.col("message_id").alias("anchor_id"), "at", F.least(F.greatest(F.col("context"), F.lit(0)), F.lit(5)).alias("context"))
    return numbered.join(asked, "conversation_id").filter(F.col("rn").between(F.col("at") - F.col("context"), F.col("at") + F.col("context"))).drop("context")
