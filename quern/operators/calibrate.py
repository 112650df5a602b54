"""Pairing by rank of size, scale estimates, quality checks and field numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest(df: DataFrame, n: int, size: str = "area_um2") -> DataFrame:
    """The n largest with their rank; the limit comes before the window, so the window sees n rows."""
    top = df.filter(F.col(size).isNotNull()).orderBy(F.desc(size), "row_idx").limit(n)
    return top.withColumn("size_rank", F.row_number().over(Window.orderBy(F.desc(size), "row_idx")).cast("long"))


def rank_pairs(a: DataFrame, b: DataFrame, n: int, size: str = "area_um2") -> DataFrame:
    left = largest(a, n, size).select("size_rank", F.col("row_idx").alias("a_idx"), F.col(size).alias("a_size"))
    return left.join(largest(b, n, size).select("size_rank", F.col("row_idx").alias("b_idx"), F.col(size).alias("b_size")), "size_rank")


def scale_estimate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.median(F.col("a_size") / F.col("b_size")).alias("scale"), F.count("*").alias("n"))


def match_quality(d: Column) -> Column:
    return F.when(d < 5, "good").when(d < 15, "uncertain").otherwise("poor")


def field_number(row: Column, col: Column, cols: int, snake: bool = True) -> Column:
    across = F.when((row % 2 == 1) & F.lit(snake), cols - 1 - col).otherwise(col)
    return row * cols + across


def marker_class(area: Column) -> Column:
    return F.when(area > 200, "large").when(area > 50, "medium").otherwise("small")


def quality_checks(stats: DataFrame, least_rate: float = 0.8, most_distance: float = 30.0) -> DataFrame:
    """PASS, WARN or FAIL of one row of match statistics."""
    rate, d = F.col("src_rate"), F.col("mean_distance")
    judge = lambda ok, near: F.when(ok, "PASS").when(near, "WARN").otherwise("FAIL")
    return stats.select(judge(rate >= least_rate, rate >= least_rate / 2).alias("match_rate"), judge(d <= most_distance, d <= 2 * most_distance).alias("distance"), judge(F.col("n_unmatched_ref") == 0, F.col("ref_rate") > 0.5).alias("unmatched"))


def match_checks(matched: DataFrame, n_detected: int, n_listed: int, d: str = "match_distance", a: str = "size_detected", b: str = "size") -> DataFrame:
    """check, status, detail: do the numbers agree, are most matches good, do the sizes go together, is anything left over?"""
    kind = match_quality(F.col(d))
    share = lambda k: F.avg((kind == k).cast("double"))
    m = matched.agg(F.count("*").alias("n"), share("good").alias("good"), share("uncertain").alias("uncertain"), share("poor").alias("poor"), F.corr(a, b).alias("r"))
    off = abs(n_detected - n_listed)
    status = {
        "Count match": F.lit("PASS" if not off else "WARN" if off <= 5 else "FAIL"),
        "Match quality distribution": F.when(F.col("good") > 0.8, "PASS").when(F.col("good") > 0.5, "WARN").otherwise("FAIL"),
        "Size correlation": F.when(F.col("r") > 0.9, "PASS").otherwise("WARN"),
        "Unmatched particles": F.when(F.col("n") == n_detected, "PASS").otherwise("WARN"),
    }
    detail = {
        "Count match": F.lit(f"Detected: {n_detected}, listed: {n_listed} ({n_detected - n_listed:+d})"),
        "Match quality distribution": F.format_string("Good: %.0f%%, Uncertain: %.0f%%, Poor: %.0f%%", 100 * F.col("good"), 100 * F.col("uncertain"), 100 * F.col("poor")),
        "Size correlation": F.format_string("r = %.3f", F.col("r")),
        "Unmatched particles": F.format_string(f"%d of {n_detected} detected particles matched", F.col("n")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), status[k].alias("status"), detail[k].alias("detail")) for k in status]))
    return m.select(rows.alias("x")).select("x.*")
