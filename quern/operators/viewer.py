"""What an interactive viewer asks: unions with status, bounds, ranges and the nearest particle."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.runs import transform_parameters


def with_status(df: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    keys = matched.select(F.col(key).alias("_k")).distinct()
    hit = df.join(keys, df["row_idx"] == keys["_k"], "left_semi").withColumn("match_status", F.lit("matched"))
    return hit.unionByName(df.join(keys, df["row_idx"] == keys["_k"], "left_anti").withColumn("match_status", F.lit("unmatched")))


def layers(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("layer"), "row_idx", "x", "y")
        out = one if out is None else out.unionByName(one)
    return out


def bounds(df: DataFrame, x: str, y: str, pad: float = 200.0, default: float = 1000.0) -> DataFrame:
    low = lambda c: F.coalesce(F.min(c) - pad, F.lit(-default))
    high = lambda c: F.coalesce(F.max(c) + pad, F.lit(default))
    return df.agg(low(x).alias("x_min"), high(x).alias("x_max"), low(y).alias("y_min"), high(y).alias("y_max"))


def ranges(df: DataFrame) -> DataFrame:
    return df.agg(F.floor(F.min("quality")).cast("double").alias("q_min"), F.ceil(F.max("quality")).cast("double").alias("q_max"), (F.ceil(F.max("feret_max_um") / 10) * 10).cast("double").alias("size_max"))


def nearest_to(df: DataFrame, x: float, y: float, cx: str = "x", cy: str = "y") -> DataFrame:
    d = F.sqrt((F.col(cx) - x) * (F.col(cx) - x) + (F.col(cy) - y) * (F.col(cy) - y))
    return df.withColumn("d", d).filter("d is not null").orderBy("d", "row_idx").limit(1)


def image_bounds(df: DataFrame, height: int, width: int, x: str = "x", y: str = "y", pad: float = 300.0) -> DataFrame:
    """The particles' extent and padding, widened on one axis to the image's aspect."""
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    sx, sy, aspect = F.col("x1") - F.col("x0") + 2 * pad, F.col("y1") - F.col("y0") + 2 * pad, width / height
    wide = sx / sy > aspect
    across, up = F.when(wide, sx).otherwise(sy * aspect) / 2, F.when(wide, sx / aspect).otherwise(sy) / 2
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return ends.select((cx - across).alias("x_min"), (cx + across).alias("x_max"), (cy - up).alias("y_min"), (cy + up).alias("y_max"))


def scan_bounds(df: DataFrame, height: int, width: int, x: str = "x_um", y: str = "y_um", cell: float = 25.0) -> DataFrame:
    """The scan's extent by its image, up to the next 500 if particles lie beyond it, centred on the particles' range.

    Without particles it begins at 0.
    """
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def axis(pixels: int, low: str, high: str) -> tuple:
        span = F.lit(round((pixels + 1) / 6) * cell)
        span = F.when(F.col(high) > span, F.ceil(F.col(high) / 500) * 500.0).otherwise(span)
        begin = F.coalesce((F.col(low) + F.col(high)) / 2 - span / 2, F.lit(0.0))
        return begin, begin + span

    (a, b), (c, d) = axis(width, "x0", "x1"), axis(height, "y0", "y1")
    return ends.select(a.alias("x_min"), b.alias("x_max"), c.alias("y_min"), d.alias("y_max"))


def third_extent(df: DataFrame, x: str = "x_um", y: str = "y_um") -> DataFrame:
    """The third instrument's image begins at 0 and ends at the next 1000 over the largest coordinate."""
    up = lambda c: (F.ceil(F.max(c) / 1000) * 1000).cast("double")
    return df.agg(F.lit(0.0).alias("x_min"), up(x).alias("x_max"), F.lit(0.0).alias("y_min"), up(y).alias("y_max"))


#: The overlay's layers, each of which can be switched on by itself.
LAYERS = ("ftir_matched", "ftir_unmatched", "raman_matched", "raman_unmatched", "ldir_matched", "ldir_unmatched", "links", "triples")


def overlay_layers(ftir: DataFrame, raman: DataFrame, matched: DataFrame, ldir: DataFrame | None = None, third: DataFrame | None = None, shown: tuple[str, ...] = LAYERS) -> DataFrame:
    """layer, row_idx, x, y, xend, yend in the aligned frame. matched and third: src_idx, ref_idx.

    Points have no end; a link leads from the first instrument's particle to its partner; triples are the reference's
    particles that both other instruments were matched with.
    """
    none = F.lit(None).cast("double")

    def points(df: DataFrame, name: str, x: str, y: str, keys: DataFrame, how: str) -> DataFrame:
        return df.join(keys, df["row_idx"] == keys["_k"], how).select(F.lit(name).alias("layer"), "row_idx", F.col(x).alias("x"), F.col(y).alias("y"), none.alias("xend"), none.alias("yend"))

    key = lambda df, c: df.select(F.col(c).alias("_k")).distinct()
    sides = [("ftir", ftir, "x_aligned", "y_aligned", key(matched, "src_idx")), ("raman", raman, "x_norm", "y_norm", key(matched, "ref_idx"))]
    if ldir is not None and third is not None:
        sides.append(("ldir", ldir, "x_aligned", "y_aligned", key(third, "src_idx")))
    out = [points(df, f"{name}_{kind}", x, y, keys, how) for name, df, x, y, keys in sides for kind, how in (("matched", "left_semi"), ("unmatched", "left_anti")) if f"{name}_{kind}" in shown]
    if "links" in shown:
        a = ftir.select(F.col("row_idx").alias("src_idx"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))
        b = raman.select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("xend"), F.col("y_norm").alias("yend"))
        out.append(matched.select("src_idx", "ref_idx").join(a, "src_idx").join(b, "ref_idx").select(F.lit("links").alias("layer"), F.col("src_idx").alias("row_idx"), "x", "y", "xend", "yend"))
    if "triples" in shown and third is not None:
        both = key(matched, "ref_idx").join(key(third, "ref_idx"), "_k", "left_semi")
        out.append(points(raman, "triples", "x_norm", "y_norm", both, "left_semi"))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def load_uploaded(spark: SparkSession, matched: str, unmatched_ftir: str | None = None, unmatched_raman: str | None = None, transform: str | None = None) -> dict:
    """Result files that a user picked: the matched table is needed, the others are optional."""
    if not matched or not Path(matched).exists():
        raise ValueError("the table of matched particles is needed")
    out: dict = {"matched": spark.read.csv(matched, header=True, inferSchema=True, nullValue="NA")}
    for name, path in (("unmatched_ftir", unmatched_ftir), ("unmatched_raman", unmatched_raman)):
        if path and Path(path).exists():
            out[name] = spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")
    if transform and Path(transform).exists():
        out["transform"] = transform_parameters(spark, transform)
    return out


def status(loaded: dict) -> dict[str, int]:
    """How many rows each loaded table has."""
    return {name: df.count() for name, df in loaded.items() if isinstance(df, DataFrame)}


def common_columns(wanted: list[str], df: DataFrame) -> list[str]:
    """The wanted columns that a table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def details(df: DataFrame) -> DataFrame:
    """row_idx and the text that a particle shows when it is pointed at."""
    return df.select("row_idx", F.concat("particle_id", F.lit(" | "), F.coalesce("material", F.lit("Unknown"))).alias("label"))


def rebound(df: DataFrame) -> DataFrame:
    """The aligned frame as the one to match in."""
    return df.withColumn("x_norm", F.col("x_aligned")).withColumn("y_norm", F.col("y_aligned"))
