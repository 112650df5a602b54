"""Run folders, manifests and parameter files."""

from __future__ import annotations

import datetime
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.strings import file_type, instrument

#: Tables of a run folder, each optional but the first.
TABLES = ["matched_particles", "unmatched_ftir", "unmatched_raman", "agreement_summary", "ldir_raman_matched", "ldir_ftir_matched", "unmatched_ldir", "triplets_3way"]


def key_values(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines "key: value" with a number where value is one."""
    parts = F.split("value", ": ", 2)
    return lines.select(*keys, F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))


def transform_parameters(spark: SparkSession, path: str) -> dict[str, float | str]:
    """A small text file of one run."""
    out: dict[str, float | str] = {}
    for row in spark.read.text(path).filter("value like '%: %'").collect():
        key, value = row.value.split(": ", 1)
        try:
            out[key.strip()] = float(value)
        except ValueError:
            out[key.strip()] = value.strip()
    return out


def manifest(files: DataFrame) -> DataFrame:
    """The last (largest) path of each instrument and file type; unknown instruments are left out."""
    known = files.select("path", instrument(F.col("path")).alias("instrument"), file_type(F.col("path")).alias("t")).filter("instrument <> 'UNKNOWN'")
    return known.groupBy("instrument").pivot("t", ["image", "tabular"]).agg(F.max("path"))


def make_run_dir(base: str) -> Path:
    today = datetime.date.today().isoformat()
    Path(base).mkdir(parents=True, exist_ok=True)
    taken = [int(m[1]) for p in Path(base).iterdir() if (m := re.fullmatch(rf"{today}_(\d+)", p.name))]
    path = Path(base) / f"{today}_{max(taken, default=0) + 1}"
    path.mkdir()
    return path


def find_latest_run(base: str) -> Path | None:
    runs = [p for p in Path(base).glob("*/") if (p / "matched_particles.csv").exists()]
    return max(runs, key=lambda p: p.stat().st_mtime, default=None)


def load_run(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    return {t: spark.read.csv(str(f), header=True, inferSchema=True, nullValue="NA") for t in TABLES if (f := Path(path) / f"{t}.csv").exists()}
