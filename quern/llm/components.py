"""Connected components of a link table, as DataFrame operations only.

Union-find dealt over the cluster: alternating large-star and small-star rounds hang
every node below the smallest node it knows. Each round is two grouped minima with
partial aggregation and two joins that AQE can split where a node has many links;
its result is written to the shared folder, so a lost executor costs one round. It ends
when every link leads from a node to the root of its star; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_written, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _done(links: DataFrame) -> bool:
    """Whether the links (u, v) are stars: no node hangs below two others, and none that hangs has nodes below it."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("leads")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("leads")))
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("leads").alias("leads"))
    return seen.filter("hangs > 1 or hangs = 1 and leads = 1").agg(F.count("*").alias("n")).first().n == 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node reachable over the links (a, b). Nodes without links aren't listed.

    Links to itself and links with a null say nothing; repeated and reversed links count once.
    """
    now = written(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().hint("rebalance"), "links")
    while not _done(now):
        last, now = now, written(_small_star(_large_star(now)).hint("rebalance"), "links")
        drop_written(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def united(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts with the components of links merged: only the links' own parts pass union-find again."""
    for side in ("a", "b"):
        links = links.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}")), side)
    moved = components(links.select("part_a", "part_b"), "part_a", "part_b").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return written(parts.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "parts")
