"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Large: each node ties its larger neighbours to its smallest one; small: its smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node each one reaches. Nodes without links are absent.

    Null ends and self-links are dropped. Every round writes its edges to the shared folder; rounds end when no edge
    changes, after a number of rounds that grows with the logarithm of the number of nodes.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = keep(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        e = keep(_star(_star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
