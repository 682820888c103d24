"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import keep


def components(edges: DataFrame, kind: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars.
    Each round is one grouped minimum and one join per star; a hub's rows are not gathered, the
    minimum is pre-aggregated and the join back may be split by adaptive skew handling. Lineage
    is cut by a table in the shared folder after each round. Only counts reach the driver.
    """
    pairs = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), kind)
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.filter("a <> b").distinct(), kind)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        pairs = keep(small.filter("a <> b").distinct(), kind)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
