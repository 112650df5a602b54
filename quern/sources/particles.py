"""Instrument exports as particle tables: delimiter sniffing, fuzzy headers, typed columns."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.strings import coordinates, find_column, number
from quern.operators.order import numbered as in_order


def read_table(spark: SparkSession, path: str, sheet: str = "Long_Table") -> DataFrame:
    """All columns as text. csv is sniffed and read as Latin-1; xlsx goes through the xlsx source."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        from quern.sources.xlsx import read_xlsx

        return read_xlsx(spark, path, sheet)
    if kind != "csv":
        raise ValueError(f"unsupported file type: {kind}")
    first = spark.read.option("encoding", "ISO-8859-1").text(path).limit(1).collect()
    head = first[0].value if first else ""
    sep = ";" if head.count(";") > head.count(",") else ","
    raw = spark.read.csv(path, header=True, sep=sep, encoding="ISO-8859-1", inferSchema=False)
    return raw.toDF(*[re.sub("[ÂÎ](?=[µμ²³¼])", "", c) for c in raw.columns])


def numbered(df: DataFrame) -> DataFrame:
    """row_idx in file order; one export is one small file, so the single window is bounded by the file."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("row_idx", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long")).drop("_at")


def synthetic_ids(df: DataFrame, prefix: str, order: str) -> DataFrame:
    return in_order(df, "_n", order).withColumn("particle_id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def _text(df: DataFrame, aliases: list[str]) -> Column:
    name = find_column(df.columns, aliases)
    return F.trim(F.col(f"`{name}`")) if name else F.lit(None).cast("string")


def _id(df: DataFrame, aliases: list[str], prefix: str) -> Column:
    name = find_column(df.columns, aliases)
    return F.col(f"`{name}`") if name else F.concat(F.lit(prefix), (F.col("row_idx") + 1).cast("string"))


def ingest_ftir(spark: SparkSession, path: str, sheet: str = "Long_Table") -> DataFrame:
    df = numbered(read_table(spark, path, sheet))
    places = [c for c in df.columns if c.lower().startswith("coord")]
    if not places:
        raise ValueError("no coordinate column")
    x, y = coordinates(F.col(f"`{([c for c in places if 'pixel' not in c.lower()] or places)[0]}`"))
    major = number(df, ["Major dim [um]", "Major dim"])
    return df.select("row_idx", _id(df, ["Identifier", "ID", "Particle"], "P_").alias("particle_id"), x.alias("x_um"), y.alias("y_um"), number(df, ["Area on map [um²]", "Area"]).alias("area_um2"), major.alias("major_um"), number(df, ["Minor dim [um]", "Minor dim"]).alias("minor_um"), number(df, ["Feret min [um]", "Feret min"]).alias("feret_min_um"), major.alias("feret_max_um"), _text(df, ["Group", "Material", "Polymer"]).alias("material"), number(df, ["Max AAU score", "AAU"]).alias("quality"), F.lit(Path(path).name).alias("source_file"))


def ingest_raman(spark: SparkSession, path: str, sheet: str = "Long_Table") -> DataFrame:
    df = numbered(read_table(spark, path, sheet))
    for axis in "XY":
        if not find_column(df.columns, [f"Visual Center Point {axis} [µm]", f"Visual Center Point {axis}"]):
            raise ValueError(f"no {axis} column")
    place = lambda axis: number(df, [f"Visual Center Point {axis} [µm]", f"Visual Center Point {axis}"])
    return df.select("row_idx", _id(df, ["Particle Name", "Particle", "ID"], "R_").alias("particle_id"), place("X").alias("x_um"), place("Y").alias("y_um"), number(df, ["Area [µm²]", "Area"]).alias("area_um2"), number(df, ["Length [µm]", "Length"]).alias("major_um"), number(df, ["Width [µm]", "Width"]).alias("minor_um"), number(df, ["Feret Min [µm]", "Feret Min"]).alias("feret_min_um"), number(df, ["Feret Max [µm]", "Feret Max"]).alias("feret_max_um"), _text(df, ["Material", "material_mapped", "material_raw", "Group", "Polymer"]).alias("material"), number(df, ["HQI", "hqi_value"]).alias("quality"), F.lit(Path(path).name).alias("source_file"))


def ingest_ldir(spark: SparkSession, path: str, sheet: str = "Particles") -> DataFrame:
    df = numbered(read_table(spark, path, sheet))
    w, h, none = number(df, ["Width"]), number(df, ["Height"]), F.lit(None).cast("double")
    top, low = F.greatest(w, h), F.least(w, h)
    return df.select("row_idx", _id(df, ["Id"], "LDIR_").alias("particle_id"), none.alias("x_um"), none.alias("y_um"), number(df, ["Area"]).alias("area_um2"), top.alias("major_um"), low.alias("minor_um"), low.alias("feret_min_um"), top.alias("feret_max_um"), _text(df, ["Identification"]).alias("material"), number(df, ["Quality"]).alias("quality"), F.lit(Path(path).name).alias("source_file"), number(df, ["Diameter"]).alias("diameter_um"), number(df, ["Aspect Ratio"]).alias("aspect_ratio"))
