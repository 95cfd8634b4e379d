"""Connected components of a link table by alternating large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Tie each node's neighbours to the smallest of them and the node.

    Large star (both): every node hands the smallest to its larger neighbours. Small star: to its smaller ones and itself.
    """
    if both:
        near = links.select(F.col("a").alias("n"), F.col("b").alias("m")).union(links.select("b", "a"))
    else:
        near = links.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = near.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
    tied = near.join(least, "n")
    if both:
        out = tied.where(F.col("m") > F.col("n")).select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        own = least.where(F.col("low") < F.col("n")).select(F.col("n").alias("a"), F.col("low").alias("b"))
        out = tied.where(F.col("m") != F.col("low")).select(F.col("m").alias("a"), F.col("low").alias("b")).union(own)
    return out.where(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node reachable. Only linked nodes come back.

    Ends when a round changes nothing; each round is cut off in the shared folder, so plans stay short.
    """
    now = cut(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, both=True), both=False))
        if (new := _mark(now)) == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
