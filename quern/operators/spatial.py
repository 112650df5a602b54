"""Neighbour joins over a grid: an equality on cells instead of a cross join.

The side that is looked up is dealt to cells as wide as the radius; the other side
asks its own cell and the eight around it. Catalyst sees an equi-join with the
distance as a residual condition and picks broadcast or shuffle by size; AQE splits
dense cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.geometry import distance


def within(src: DataFrame, ref: DataFrame, radius: float | Column, cell: float, src_key: str = "src_idx", ref_key: str = "ref_idx") -> DataFrame:
    """Pairs at most radius apart with their distance d. src and ref have x, y; radius may be a column of src, at most cell."""
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / cell).cast("long") - 1, F.floor(F.col(c) / cell).cast("long") + 1))
    asking = src.filter("x is not null and y is not null").withColumnRenamed("x", "sx").withColumnRenamed("y", "sy")
    asking = asking.withColumn("cx", near("sx")).withColumn("cy", near("sy"))
    asked = ref.filter("x is not null and y is not null").withColumnRenamed("x", "rx").withColumnRenamed("y", "ry")
    asked = asked.withColumn("cx", F.floor(F.col("rx") / cell).cast("long")).withColumn("cy", F.floor(F.col("ry") / cell).cast("long"))
    d = distance(F.col("sx"), F.col("sy"), F.col("rx"), F.col("ry"))
    limit = radius if isinstance(radius, Column) else F.lit(float(radius))
    return asking.join(asked, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= limit).drop("cx", "cy")


def ranked(pairs: DataFrame, k: int, src_key: str = "src_idx", ref_key: str = "ref_idx") -> DataFrame:
    """The k nearest of each source; equal distances by ref index."""
    w = Window.partitionBy(src_key).orderBy("d", ref_key)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(pairs: DataFrame, src_key: str = "src_idx", ref_key: str = "ref_idx") -> DataFrame:
    """The nearest partner of each source, by an aggregate that combines before the shuffle."""
    best = pairs.groupBy(src_key).agg(F.min(F.struct("d", ref_key)).alias("best"))
    return best.select(src_key, F.col(f"best.{ref_key}").alias(ref_key), F.col("best.d").alias("d"))


def mutual(pairs: DataFrame) -> DataFrame:
    """Pairs of which each is the other's nearest."""
    back = nearest(pairs, "ref_idx", "src_idx").select("ref_idx", "src_idx")
    return nearest(pairs).join(back, ["src_idx", "ref_idx"])


def inliers(src: DataFrame, ref: DataFrame, radius: float) -> DataFrame:
    """Sources with any reference within the radius."""
    hit = within(src.select("src_idx", "x", "y"), ref.select("ref_idx", "x", "y"), radius, radius).select("src_idx").distinct()
    return src.join(hit, "src_idx", "left_semi")
