"""Particle-shaped views over the generic test tables, as DataFrames and as DuckDB common table expressions.

A planted similarity ties the source view to the reference view, so the true partner of
source row i is reference row i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.geometry import Transform

REF_NAMES = ["Polyethylene terephtalate (PET)", "Polypropylene (PP)", "Polyethylene (PE)", "Polyamide (PA Nylon 12)", "Cellulose Acetate Butyrate (CAB)", "Polyacrylamide/acrylate", "Polycarbonate (PC)", "Polytetrafluoroethylene (PTFE)", "Polyvinyl Chloride (PVC)", "Polyphenylene sulphide (PPS)"]
SRC_NAMES = ["PET", "Polypro", "HDPE", "Nylon 6", "Cellulose", "Protein", "PC", "Teflon", "PVC", "Unknown"]
THIRD_NAMES = ["Polyethylene terephthalate", "Polypropylene", "Polyethylene", "Polyamide (naturally occurring)", "Cellulosic", "Rubber", "Polycarbonate", "Polytetrafluoroethylene", "Polyvinyl chloride", "Carbonate"]
PLANTED = Transform(-0.995138, 0.074362, 135.43, -406.44)
PLANTED_THIRD = Transform(0.745, 0.667, -1038.8, -329.0)


def _name(names: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def _e(i: int) -> Column:
    return F.get("embedding", F.lit(i)).cast("double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    u, w = 20 + F.abs(_e(2)) * 1000, 10 + F.abs(_e(3)) * 400
    x, y = _e(0) * 20000, _e(1) * 20000
    major, minor = F.when(v % 43 != 7, F.greatest(u, w)), F.least(u, w)
    x, y = F.when(v % 97 != 5, x), F.when(v % 97 != 5, y)
    return table(spark, sf_dir, "embeddings").select(v.alias("row_idx"), F.concat(F.lit("R_"), v).alias("particle_id"), x.alias("x_um"), y.alias("y_um"), x.alias("x_norm"), y.alias("y_norm"), (0.785 * major * minor).alias("area_um2"), major.alias("major_um"), minor.alias("minor_um"), major.alias("feret_max_um"), minor.alias("feret_min_um"), F.when(v % 41 != 11, F.least(F.lit(100.0), F.abs(_e(4)) * 600)).alias("quality"), F.when(v % 37 != 3, _name(REF_NAMES, F.col("label"))).alias("material"))


REF = f"""fx_ref AS (
 SELECT vec_id AS row_idx, 'R_' || vec_id AS particle_id, x AS x_um, y AS y_um, x AS x_norm, y AS y_norm,
  0.785 * major * minor AS area_um2, major AS major_um, minor AS minor_um, major AS feret_max_um, minor AS feret_min_um, quality, material
 FROM (SELECT vec_id, CASE WHEN vec_id % 97 <> 5 THEN e0 * 20000 END AS x, CASE WHEN vec_id % 97 <> 5 THEN e1 * 20000 END AS y,
   CASE WHEN vec_id % 43 <> 7 THEN greatest(20 + abs(e2) * 1000, 10 + abs(e3) * 400) END AS major, least(20 + abs(e2) * 1000, 10 + abs(e3) * 400) AS minor,
   CASE WHEN vec_id % 41 <> 11 THEN least(100.0::DOUBLE, abs(e4) * 600) END AS quality, CASE WHEN vec_id % 37 <> 3 THEN ({REF_NAMES!r})[label + 1] END AS material
  FROM (SELECT vec_id, label, embedding[1]::DOUBLE e0, embedding[2]::DOUBLE e1, embedding[3]::DOUBLE e2, embedding[4]::DOUBLE e3, embedding[5]::DOUBLE e4 FROM embeddings)))"""


def _raw(t: Transform, jx: Column, jy: Column) -> tuple[Column, Column]:
    """The point that t carries to the reference place plus jitter."""
    s = t.a * t.a + t.b * t.b
    dx, dy = _e(0) * 20000 + jx - t.tx, _e(1) * 20000 + jy - t.ty
    return (t.a * dx + t.b * dy) / s, (-t.b * dx + t.a * dy) / s


def _source(spark: SparkSession, sf_dir: str, every: int, prefix: str, t: Transform, jx: Column, jy: Column, grow: Column, names: list[str], at: Column, quality: Column) -> DataFrame:
    v = F.col("vec_id")
    u, w = (20 + F.abs(_e(2)) * 1000) * grow, (10 + F.abs(_e(3)) * 400) * grow
    x, y = _raw(t, jx, jy)
    major, minor = F.greatest(u, w), F.least(u, w)
    return table(spark, sf_dir, "embeddings").filter(v % every == 0).select(v.alias("row_idx"), F.concat(F.lit(prefix), v).alias("particle_id"), (x + 6600).alias("x_um"), (y + 5000).alias("y_um"), x.alias("x_norm"), y.alias("y_norm"), (0.785 * major * minor).alias("area_um2"), major.alias("major_um"), minor.alias("minor_um"), major.alias("feret_max_um"), minor.alias("feret_min_um"), quality.alias("quality"), _name(names, at).alias("material"))


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("label") + (F.col("vec_id") % 3 == 0).cast("int")) % 10
    return _source(spark, sf_dir, 2, "P_", PLANTED, _e(5) * 150, _e(6) * 150, 1 + _e(7), SRC_NAMES, at, F.least(F.lit(1.0), F.abs(_e(8)) * 6))


def third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, 3, "L_", PLANTED_THIRD, _e(8) * 300, _e(9) * 300, 1 + _e(7), THIRD_NAMES, F.col("label") % 10, F.least(F.lit(1.0), F.abs(_e(10)) * 6))


def _source_sql(name: str, every: int, prefix: str, t: Transform, jx: str, jy: str, names: list[str], at: str, quality: str) -> str:
    s = f"({t.a!r}::DOUBLE * {t.a!r}::DOUBLE + {t.b!r}::DOUBLE * {t.b!r}::DOUBLE)"
    e = ", ".join(f"embedding[{i + 1}]::DOUBLE e{i}" for i in range(11))
    return f"""{name} AS (
 SELECT vec_id AS row_idx, '{prefix}' || vec_id AS particle_id, x + 6600 AS x_um, y + 5000 AS y_um, x AS x_norm, y AS y_norm,
  0.785 * greatest(u, w) * least(u, w) AS area_um2, greatest(u, w) AS major_um, least(u, w) AS minor_um, greatest(u, w) AS feret_max_um, least(u, w) AS feret_min_um, quality, material
 FROM (SELECT vec_id, ({t.a!r} * dx + {t.b!r} * dy) / {s} AS x, ({-t.b!r} * dx + {t.a!r} * dy) / {s} AS y, u, w, quality, material
  FROM (SELECT vec_id, e0 * 20000 + {jx} - ({t.tx!r}) AS dx, e1 * 20000 + {jy} - ({t.ty!r}) AS dy, (20 + abs(e2) * 1000) * (1 + e7) AS u, (10 + abs(e3) * 400) * (1 + e7) AS w,
    {quality} AS quality, ({names!r})[{at} + 1] AS material
   FROM (SELECT vec_id, label, {e} FROM embeddings WHERE vec_id % {every} = 0))))"""


SRC = _source_sql("fx_src", 2, "P_", PLANTED, "e5 * 150", "e6 * 150", SRC_NAMES, "((label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10)", "least(1.0::DOUBLE, abs(e8) * 6)")
THIRD = _source_sql("fx_third", 3, "L_", PLANTED_THIRD, "e8 * 300", "e9 * 300", THIRD_NAMES, "(label % 10)", "least(1.0::DOUBLE, abs(e10) * 6)")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return cells.select("row", F.col("col").cast("long").alias("col"), (F.abs(F.col("v").cast("double")) * 255).alias("value"))


PIXELS = "fx_pixels AS (SELECT vec_id AS row, (unnest(range(1, 65)) - 1)::BIGINT AS col, abs(unnest(embedding)::DOUBLE) * 255 AS value FROM embeddings)"


def events_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with a unique key."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("match_id"), _name(SRC_NAMES, F.col("user_id") % 10).alias("material_a"), _name(REF_NAMES, F.col("event_id") % 10).alias("material_b"), F.col("value").cast("double").alias("match_distance"))


EVENTS = f"fx_events AS (SELECT event_id AS match_id, ({SRC_NAMES!r})[user_id % 10 + 1] AS material_a, ({REF_NAMES!r})[event_id % 10 + 1] AS material_b, value::DOUBLE AS match_distance FROM events)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many matched pairs without a key."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(_name(SRC_NAMES, F.col("l_partkey") % 10).alias("material_a"), _name(REF_NAMES, F.col("l_suppkey") % 10).alias("material_b"), (F.col("l_quantity").cast("double") * 2).alias("match_distance"), (F.col("l_extendedprice").cast("double") / 200).alias("feret"), (F.col("l_discount").cast("double") * 1000).alias("quality"))


PAIRS = f"fx_pairs AS (SELECT ({SRC_NAMES!r})[l_partkey % 10 + 1] AS material_a, ({REF_NAMES!r})[l_suppkey % 10 + 1] AS material_b, l_quantity::DOUBLE * 2 AS match_distance, l_extendedprice::DOUBLE / 200 AS feret, l_discount::DOUBLE * 1000 AS quality FROM lineitem)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material names with case, blanks and suffixes."""
    p = F.col("p_partkey")
    every = REF_NAMES + SRC_NAMES + THIRD_NAMES
    base = _name(every, p % 30)
    noisy = F.when(p % 7 == 0, F.upper(base)).when(p % 7 == 1, F.concat(F.lit("  "), base, F.lit(" "))).when(p % 7 == 2, F.concat(base, F.lit(" Lab bench"))).when(p % 7 == 3, F.concat(base, F.lit(" Nylon 6"))).when(p % 7 == 4, F.lower(base)).otherwise(base)
    return table(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 31 == 30, F.lit(None)).when(p % 31 == 29, "  ").otherwise(noisy).alias("name"))


NAMES = f"""fx_names AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 30 THEN NULL WHEN p_partkey % 31 = 29 THEN '  ' WHEN p_partkey % 7 = 0 THEN upper(base) WHEN p_partkey % 7 = 1 THEN '  ' || base || ' '
  WHEN p_partkey % 7 = 2 THEN base || ' Lab bench' WHEN p_partkey % 7 = 3 THEN base || ' Nylon 6' WHEN p_partkey % 7 = 4 THEN lower(base) ELSE base END AS name
 FROM (SELECT p_partkey, ({REF_NAMES + SRC_NAMES + THIRD_NAMES!r})[p_partkey % 30 + 1] AS base FROM part))"""

FILE_PATTERNS = ["run {} LDIR a.xlsx", "Spotlight {}.csv", "8700_{}.png", "foo{}.csv", "x FTIR {}.PNG", "raman-{}.jpeg", "IR {}.txt", "dir/infrared/{}"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    pattern = _name(FILE_PATTERNS, p % 8)
    return table(spark, sf_dir, "part").select(p.alias("id"), F.replace(pattern, F.lit("{}"), p.cast("string")).alias("path"))


FILES = f"fx_files AS (SELECT p_partkey AS id, replace(({FILE_PATTERNS!r})[p_partkey % 8 + 1], '{{}}', p_partkey::VARCHAR) AS path FROM part)"


def sql(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {body}" if views else body
