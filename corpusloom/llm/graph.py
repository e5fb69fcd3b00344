"""Connected components of an edge table, by joins and aggregates that Spark can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the smallest node around it.

    No neighbour list is gathered: the smallest is a plain aggregate, joined back to the edges.
    """
    around = edges.union(edges.select("b", "a")) if large else edges
    least = around.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    linked = around.join(least, F.col("a") == F.col("node"))
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for each node of edges (a, b).

    Alternates large stars and small stars until nothing moves; each round is written to the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = stored(_star(_star(now, large=True), large=False), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component")).distinct()
