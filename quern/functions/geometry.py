"""Similarity transforms and match costs as Column expressions and small records."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    """x' = a x - b y + tx, y' = b x + a y + ty; reflected: x' = a x + b y + tx, y' = b x - a y + ty."""

    a: float = 1.0
    b: float = 0.0
    tx: float = 0.0
    ty: float = 0.0
    reflected: bool = False

    @property
    def matrix(self) -> list[list[float]]:
        s = -1 if self.reflected else 1
        return [[self.a, -s * self.b, self.tx], [self.b, s * self.a, self.ty], [0.0, 0.0, 1.0]]

    @property
    def scale(self) -> float:
        return math.hypot(self.a, self.b)

    @property
    def rotation_deg(self) -> float:
        return math.degrees(math.atan2(self.b, self.a))

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        s = -1 if self.reflected else 1
        return self.a * x - s * self.b * y + self.tx, self.b * x + s * self.a * y + self.ty

    def after(self, first: "Transform") -> "Transform":
        """This transform applied to what first gives."""
        (a, b, tx), (c, d, ty), _ = self.matrix
        (e, _, fx), (g, _, fy), _ = first.matrix
        flip = self.reflected != first.reflected
        return Transform(a * e + b * g, c * e + d * g, a * fx + b * fy + tx, c * fx + d * fy + ty, flip)

    @classmethod
    def rotation(cls, degrees: float, mirrored: bool = False, tx: float = 0.0, ty: float = 0.0) -> "Transform":
        r = math.radians(degrees)
        return cls(math.cos(r), math.sin(r), tx, ty, mirrored)


def aligned(df: DataFrame, transform: Transform, x: str = "x_norm", y: str = "y_norm") -> DataFrame:
    ax, ay = transform.columns(F.col(x), F.col(y))
    return df.withColumn("x_aligned", ax).withColumn("y_aligned", ay)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def adaptive_threshold(major: Column, base: float = 100.0, fraction: float = 0.15) -> Column:
    return F.greatest(F.lit(base), fraction * F.coalesce(major, F.lit(0.0)))


def elongation_weight(major: Column, minor: Column, alpha: float = 0.5) -> Column:
    aspect = F.when(minor > 0, major / minor)
    return 1 / (1 + alpha * F.greatest(F.coalesce(aspect, F.lit(1.0)) - 1, F.lit(0.0)))


def _log_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.when((a > 0) & (b > 0), F.abs(F.log(a / b))), F.lit(0.0))


def feature_cost(d: Column, s: dict[str, Column], r: dict[str, Column], weights: tuple[float, float, float] = (0.3, 0.3, 0.1)) -> Column:
    """Distance plus weighted differences of area, feret and aspect; a missing measure adds nothing."""
    asp = {k: v["major"] / F.greatest(v["minor"], F.lit(1.0)) for k, v in (("s", s), ("r", r))}
    shape = F.coalesce(F.abs(asp["s"] - asp["r"]) / F.greatest(asp["s"], asp["r"], F.lit(1.0)), F.lit(0.0))
    return d + weights[0] * _log_ratio(s["area"], r["area"]) + weights[1] * _log_ratio(s["feret"], r["feret"]) + weights[2] * shape


def greedy_score(d: Column, s: Column, r: Column, weight: float = 0.2) -> Column:
    return d + F.coalesce(F.when((s + r) > 0, weight * F.abs(s - r) / ((s + r) / 2)), F.lit(0.0))


def size_cost(area_s: Column, area_r: Column, feret_s: Column, feret_r: Column) -> Column:
    least = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(1e-6)))
    term = lambda a, b: F.coalesce(F.abs(F.log(least(a) / least(b))), F.lit(0.0))
    return term(area_s, area_r) + 0.5 * term(feret_s, feret_r)


def pixel_to_um(c: Column, low: float, span: float, pixels: int, step: int = 1, half: bool = True, flip: bool = False) -> Column:
    """A (downsampled) pixel coordinate as a place; half: pixel centres lie half a pixel in; flip: the axis runs the other way."""
    at = (c - (0.5 if half else 0.0)) * step * (span / pixels)
    return low + span - at if flip else low + at


def scan_extent(pixels: Column, cell: float = 25.0) -> Column:
    """Width of a scan from its image: one cell for six pixels."""
    return F.bround((pixels + 1) / 6, 0) * cell


MIRROR_Y = Transform(reflected=True)
