"""Selections, with the engine's rules for nulls: some filters keep unknown values, others drop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least_or_unknown(c: Column, t: float) -> Column:
    return c.isNull() | (c >= t) if t > 0 else F.lit(True)


def known_at_least(df: DataFrame, c: str, t: float) -> DataFrame:
    """Drops nulls, unless the whole column is null or the threshold is off."""
    if t <= 0 or df.filter(F.col(c).isNotNull()).limit(1).count() == 0:
        return df
    return df.filter(F.col(c) >= t)


def placed(df: DataFrame, x: str = "x_um", y: str = "y_um") -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def prefilter_ftir(df: DataFrame, min_quality: float = 0.0, min_size: float = 0.0) -> DataFrame:
    return placed(df).filter(at_least_or_unknown(F.col("quality"), min_quality) & at_least_or_unknown(F.col("feret_max_um"), min_size))


def prefilter_raman(df: DataFrame, min_hqi: float = 70.0, min_size: float = 0.0) -> DataFrame:
    return known_at_least(placed(df), "quality", min_hqi).filter(at_least_or_unknown(F.col("feret_max_um"), min_size))


def prefilter_ldir(df: DataFrame, min_quality: float = 0.6, min_size: float = 0.0) -> DataFrame:
    return df.filter(at_least_or_unknown(F.col("quality"), min_quality) & at_least_or_unknown(F.col("feret_max_um"), min_size))


def anchors(df: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return df.filter(F.coalesce(F.col("material").rlike("(?i)" + "|".join(patterns)), F.lit(False)))


def anchors_or_all(df: DataFrame, patterns: tuple[str, ...], least: int = 4) -> DataFrame:
    some = anchors(df, patterns)
    return some if some.limit(least).count() >= least else df


def anchor_gate(df: DataFrame, min_size: float = 20.0, min_hqi: float = 70.0) -> DataFrame:
    sized = df.filter(at_least_or_unknown(F.col("feret_max_um"), min_size))
    return known_at_least(sized, "quality", min_hqi)


def landmarks(df: DataFrame, size: float = 100.0, aspect: float = 3.0, fiber: float = 100.0) -> DataFrame:
    f = F.col("feret_max_um")
    return df.filter((f >= size) | ((F.col("major_um") / F.col("minor_um") >= aspect) & (f >= fiber)))


def instrument_view(df: DataFrame, quality: tuple[float, float], size: tuple[float, float], materials: list[str] | None = None, status: list[str] | None = None) -> DataFrame:
    """Closed ranges; unknown values are dropped; no materials or "All" takes every material."""
    out = df.filter(F.col("quality").between(*quality) & F.col("feret_max_um").between(*size))
    if materials and "All" not in materials:
        out = out.filter(F.col("material").isin(materials))
    return out.filter(F.col("match_status").isin(status)) if status else out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
