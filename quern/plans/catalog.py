"""All queries of the library by name, each with its DuckDB equivalent where SQL has one.

Queries apply the library's operators to the fixture views. Names begin with the
operator's inventory id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import geometry as G
from quern.functions import materials as M
from quern.functions import strings as S
from quern.operators import agreement as A
from quern.operators import filters as L
from quern.operators import fit, imaging, matching, spatial
from quern.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = X.sql(oracle, *views)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


T = X.PLANTED
SRC_ALIGNED = f"src_al AS (SELECT *, {T.a!r} * x_norm - {T.b!r} * y_norm + {T.tx!r} AS x_aligned, {T.b!r} * x_norm + {T.a!r} * y_norm + ({T.ty!r}) AS y_aligned FROM fx_src)"
CAND = """cand AS (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY d, ref_idx) AS rank FROM (
 SELECT s.row_idx AS src_idx, r.row_idx AS ref_idx, sqrt((s.x_aligned - r.x_norm) * (s.x_aligned - r.x_norm) + (s.y_aligned - r.y_norm) * (s.y_aligned - r.y_norm)) AS d,
  s.area_um2 sa, r.area_um2 ra, s.feret_max_um sf, r.feret_max_um rf, s.major_um / greatest(s.minor_um, 1.0::DOUBLE) sp, r.major_um / greatest(r.minor_um, 1.0::DOUBLE) rp, greatest(100.0::DOUBLE, 0.15 * coalesce(s.major_um, 0)) t
 FROM src_al s, fx_ref r WHERE r.x_norm IS NOT NULL) WHERE d <= t)"""
COST = "d + 0.3 * coalesce(CASE WHEN sa > 0 AND ra > 0 THEN abs(ln(sa / ra)) END, 0) + 0.3 * coalesce(CASE WHEN sf > 0 AND rf > 0 THEN abs(ln(sf / rf)) END, 0) + 0.1 * CASE WHEN rp IS NULL OR sp IS NULL THEN 0 ELSE abs(sp - rp) / greatest(sp, rp, 1.0::DOUBLE) END"
SCORE = "d + coalesce(CASE WHEN sf + rf > 0 THEN 0.2 * abs(sf - rf) / ((sf + rf) / 2) END, 0)"
NEAR = "near AS (SELECT src_idx, ref_idx, d AS match_distance FROM cand WHERE rank = 1)"
BASE = (X.REF, X.SRC, SRC_ALIGNED)
GRADED_SQL = f"""graded AS (SELECT *, CASE WHEN family_a = 'Unknown' OR family_b = 'Unknown' OR family_a <> family_b THEN 'Disagree' WHEN upper(trim(material_a)) = upper(trim(material_b)) THEN 'Exact' ELSE 'Family' END AS tier, material_a_norm = material_b_norm AS agree_exact
 FROM (SELECT p.*, a.norm AS material_a_norm, b.norm AS material_b_norm, a.fam AS family_a, b.fam AS family_b, {M.category_sql('a.fam')} AS category_a
  FROM {{}} p JOIN (SELECT material_a AS n, {M.normal_sql('material_a')} AS norm, {M.family_sql('material_a')} AS fam FROM (SELECT DISTINCT material_a FROM {{}})) a ON a.n = p.material_a
  JOIN (SELECT material_b AS n, {M.normal_sql('material_b')} AS norm, {M.family_sql('material_b')} AS fam FROM (SELECT DISTINCT material_b FROM {{}})) b ON b.n = p.material_b))"""
GRADED_EVENTS, GRADED_PAIRS = (GRADED_SQL.replace("{}", v) for v in ("fx_events", "fx_pairs"))
TIERS = "count(*) AS n_pairs, count(*) FILTER (tier = 'Exact') AS n_exact, count(*) FILTER (tier = 'Family') AS n_family, count(*) FILTER (tier = 'Disagree') AS n_disagree"
SHARES = "round_even(100.0::DOUBLE * n_exact / n_pairs, 1) AS exact_pct, round_even(100.0::DOUBLE * (n_exact + n_family) / n_pairs, 1) AS family_or_better_pct"


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return G.aligned(X.src(spark, d), T)


def cands(spark: SparkSession, d: str) -> DataFrame:
    return matching.candidates(aligned(spark, d), X.ref(spark, d))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return cands(spark, d).filter("rank = 1").select("src_idx", "ref_idx", F.col("d").alias("match_distance"))


def graded(spark: SparkSession, d: str, of=X.events_pairs) -> DataFrame:
    return A.paired(of(spark, d))


@query("src_2_csv_delimiter", "SELECT id, CASE WHEN length(h) - length(replace(h, ';', '')) > length(h) - length(replace(h, ',', '')) THEN ';' ELSE ',' END AS delimiter FROM (SELECT p_partkey AS id, repeat('a;', p_partkey % 4) || repeat('b,', p_partkey % 3) AS h FROM part)")
def src_2(spark, d):
    p = F.col("p_partkey")
    h = F.concat(F.repeat(F.lit("a;"), (p % 4).cast("int")), F.repeat(F.lit("b,"), (p % 3).cast("int")))
    return X.table(spark, d, "part").select(p.alias("id"), S.delimiter(h).alias("delimiter"))


@query("src_9_gray", "SELECT row, col, round(0.299 * value + 0.587 * (value / 2) + 0.114 * (value / 4), 6) AS gray FROM fx_pixels", X.PIXELS)
def src_9(spark, d):
    v = F.col("value")
    return X.pixels(spark, d).select("row", "col", r6(imaging.gray_weighted(v, v / 2, v / 4)).alias("gray"))


@query("src_14_transform_text", "SELECT id, split_part(line, ': ', 1) AS key, TRY_CAST(split_part(line, ': ', 2) AS DOUBLE) AS value FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Scale: 0.9' || p_partkey WHEN p_partkey % 3 = 1 THEN 'tx: -' || p_partkey || '.5' ELSE 'Reflected: FALSE' END AS line FROM part)")
def src_14(spark, d):
    from quern.sources.runs import key_values

    p = F.col("p_partkey")
    line = F.when(p % 3 == 0, F.concat(F.lit("Scale: 0.9"), p)).when(p % 3 == 1, F.concat(F.lit("tx: -"), p, F.lit(".5"))).otherwise("Reflected: FALSE")
    return key_values(X.table(spark, d, "part").select(p.alias("id"), line.alias("value")), "id")


INSTR = "CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), 'LDIR|8700', 'i') THEN 'LDIR' WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), 'FTIR|Spotlight|infrared|IR\\b|FT-IR', 'i') THEN 'FTIR' WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), 'Raman', 'i') THEN 'Raman' ELSE 'UNKNOWN' END"
FTYPE = "CASE WHEN lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp') THEN 'image' ELSE 'tabular' END"


@query("src_15_instrument", f"SELECT id, {INSTR} AS instrument FROM fx_files", X.FILES)
def src_15(spark, d):
    return X.files(spark, d).select("id", S.instrument(F.col("path")).alias("instrument"))


@query("src_16_file_type", f"SELECT id, {FTYPE} AS file_type FROM fx_files", X.FILES)
def src_16(spark, d):
    return X.files(spark, d).select("id", S.file_type(F.col("path")).alias("file_type"))


@query("src_17_manifest", f"SELECT instrument, max(path) FILTER (t = 'image') AS image, max(path) FILTER (t = 'tabular') AS tabular FROM (SELECT path, {INSTR} AS instrument, {FTYPE} AS t FROM fx_files) WHERE instrument <> 'UNKNOWN' GROUP BY instrument", X.FILES)
def src_17(spark, d):
    from quern.sources.runs import manifest

    return manifest(X.files(spark, d))


@query("prj_1_header", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower('  Area ' || p_partkey || '   [µm²]'), '[µμ²³â]', '', 'g'), '\\s+', ' ', 'g')) AS header FROM part")
def prj_1(spark, d):
    p = F.col("p_partkey")
    return X.table(spark, d, "part").select(p.alias("id"), S.normal_header_column(F.concat(F.lit("  Area "), p, F.lit("   [µm²]"))).alias("header"))


@query("prj_3_number", "SELECT p_partkey AS id, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE p_partkey || '.25' END AS DOUBLE) AS value FROM part")
def prj_3(spark, d):
    p = F.col("p_partkey")
    raw = X.table(spark, d, "part").select(p.alias("id"), F.when(p % 3 == 0, "n/a").otherwise(F.concat(p, F.lit(".25"))).alias("Size [um]"))
    return raw.select("id", S.number(raw, ["size [um]"]).alias("value"))


@query("prj_4_coordinates", "SELECT id, TRY_CAST(p[1] AS DOUBLE) AS x, TRY_CAST(p[2] AS DOUBLE) AS y FROM (SELECT id, string_split(regexp_replace(t, '[\\[\\]]', '', 'g'), ';') AS p FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '[' || p_partkey || ']' WHEN p_partkey % 5 = 1 THEN '[a;' || p_partkey || ']' ELSE '[' || p_partkey || '.5;-' || p_partkey || ']' END AS t FROM part))")
def prj_4(spark, d):
    p = F.col("p_partkey")
    t = F.when(p % 5 == 0, F.concat(F.lit("["), p, F.lit("]"))).when(p % 5 == 1, F.concat(F.lit("[a;"), p, F.lit("]"))).otherwise(F.concat(F.lit("["), p, F.lit(".5;-"), p, F.lit("]")))
    x, y = S.coordinates(t)
    return X.table(spark, d, "part").select(p.alias("id"), x.alias("x"), y.alias("y"))


@query("prj_5_ids", "SELECT row_idx, 'P_' || row_number() OVER (ORDER BY row_idx) AS particle_id FROM fx_ref WHERE quality IS NULL", X.REF)
def prj_5(spark, d):
    from quern.sources.particles import synthetic_ids

    return synthetic_ids(X.ref(spark, d).filter("quality is null").select("row_idx"), "P_", "row_idx")


def _normal(spark, d, scale):
    from quern.operators.normalize import centred

    return centred(X.src(spark, d).select("row_idx", "x_um", "y_um"), scale)


@query("prj_6_centre", "SELECT row_idx, round(x_um - avg(x_um) OVER (), 6) AS x_norm, round(y_um - avg(y_um) OVER (), 6) AS y_norm FROM fx_src", X.SRC)
def prj_6(spark, d):
    return _normal(spark, d, False).select("row_idx", r6("x_norm").alias("x_norm"), r6("y_norm").alias("y_norm"))


@query("prj_6_centre_scaled", "SELECT row_idx, round(x / s, 6) AS x_norm, round(y / s, 6) AS y_norm FROM (SELECT *, sqrt(avg(x * x + y * y) OVER ()) AS s FROM (SELECT row_idx, x_um - avg(x_um) OVER () AS x, y_um - avg(y_um) OVER () AS y FROM fx_src))", X.SRC)
def prj_6s(spark, d):
    return _normal(spark, d, True).select("row_idx", r6("x_norm").alias("x_norm"), r6("y_norm").alias("y_norm"))


@query("prj_7_anchor_centroid", "SELECT row_idx, round(x_um - (SELECT avg(x_um) FROM fx_src WHERE regexp_matches(material, 'PET|Polypro', 'i')), 6) AS x_norm, round(y_um - (SELECT avg(y_um) FROM fx_src WHERE regexp_matches(material, 'PET|Polypro', 'i')), 6) AS y_norm FROM fx_src", X.SRC)
def prj_7(spark, d):
    from quern.operators.normalize import by_centroid, centroid

    s = X.src(spark, d).select("row_idx", "x_um", "y_um", "material")
    return by_centroid(s, centroid(L.anchors(s, Config().ftir_anchors))).select("row_idx", r6("x_norm").alias("x_norm"), r6("y_norm").alias("y_norm"))


@query("prj_10_apply_transform", "SELECT row_idx, round(x_aligned, 6) AS x_aligned, round(y_aligned, 6) AS y_aligned FROM src_al", X.SRC, SRC_ALIGNED)
def prj_10(spark, d):
    return rounded(aligned(spark, d).select("row_idx", "x_aligned", "y_aligned"))


@query("prj_11_parameters", f"SELECT round(sqrt({T.a!r}::DOUBLE * {T.a!r} + {T.b!r}::DOUBLE * {T.b!r}), 6) AS scale, round(degrees(atan2({T.b!r}::DOUBLE, {T.a!r}::DOUBLE)), 6) AS rotation_deg, false AS reflected")
def prj_11(spark, d):
    t = spark.createDataFrame([(T.a, T.b, T.reflected)], "a double, b double, reflected boolean")
    return t.select(r6(F.hypot("a", "b")).alias("scale"), r6(F.degrees(F.atan2("b", "a"))).alias("rotation_deg"), "reflected")


@query("prj_12_full_transform", f"SELECT row_idx, round({T.a!r} * (x_um - 6600) - {T.b!r} * (y_um - 5000) + {T.tx!r}, 5) AS x, round({T.b!r} * (x_um - 6600) + {T.a!r} * (y_um - 5000) + ({T.ty!r}), 5) AS y FROM fx_src", X.SRC)
def prj_12(spark, d):
    full = T.after(G.Transform(tx=-6600.0, ty=-5000.0))
    out = G.aligned(X.src(spark, d), full, "x_um", "y_um")
    return out.select("row_idx", F.round("x_aligned", 5).alias("x"), F.round("y_aligned", 5).alias("y"))


@query("prj_19_elongation", "SELECT row_idx, round(1 / (1 + 0.5 * greatest(coalesce(CASE WHEN minor_um > 0 THEN major_um / minor_um END, 1.0) - 1, 0)), 6) AS weight FROM fx_ref", X.REF)
def prj_19(spark, d):
    return X.ref(spark, d).select("row_idx", r6(G.elongation_weight(F.col("major_um"), F.col("minor_um"))).alias("weight"))


@query("prj_20_threshold", "SELECT row_idx, round(greatest(100.0::DOUBLE, 0.15 * coalesce(major_um, 0)), 6) AS threshold FROM fx_ref", X.REF)
def prj_20(spark, d):
    return X.ref(spark, d).select("row_idx", r6(G.adaptive_threshold(F.col("major_um"))).alias("threshold"))


@query("prj_21_feature_cost", f"SELECT src_idx, ref_idx, round({COST}, 6) AS cost FROM cand WHERE rank <= 20", *BASE, CAND)
def prj_21(spark, d):
    return cands(spark, d).select("src_idx", "ref_idx", r6("cost").alias("cost"))


@query("prj_22_greedy_score", f"SELECT src_idx, ref_idx, round({SCORE}, 6) AS score FROM cand WHERE rank <= 20", *BASE, CAND)
def prj_22(spark, d):
    return cands(spark, d).select("src_idx", "ref_idx", r6("score").alias("score"))


SIZE_COST = "coalesce(abs(ln(greatest(s.area_um2, 1e-6) / greatest(r.area_um2, 1e-6))), 0) + 0.5 * coalesce(abs(ln(greatest(s.feret_max_um, 1e-6) / greatest(r.feret_max_um, 1e-6))), 0)"
SIZE_COST = SIZE_COST.replace("greatest(r.area_um2, 1e-6)", "CASE WHEN r.area_um2 IS NOT NULL THEN greatest(r.area_um2, 1e-6) END").replace("greatest(r.feret_max_um, 1e-6)", "CASE WHEN r.feret_max_um IS NOT NULL THEN greatest(r.feret_max_um, 1e-6) END")


@query("jn_5_size_costs", f"SELECT src_idx, round(min(c), 6) AS least, round(max(c), 6) AS most, count(*) AS n FROM (SELECT s.row_idx AS src_idx, {SIZE_COST} AS c FROM fx_third s, fx_ref r) GROUP BY src_idx", X.REF, X.THIRD)
def jn_5(spark, d):
    e = matching.size_edges(X.third(spark, d), X.ref(spark, d))
    return rounded(e.groupBy("src_idx").agg(F.min("cost").alias("least"), F.max("cost").alias("most"), F.count("*").alias("n")))


@query("prj_25_prefixed", "SELECT n.src_idx, n.ref_idx, s.particle_id AS src_particle_id, s.material AS src_material, r.particle_id AS ref_particle_id, r.material AS ref_material FROM near n JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx", *BASE, CAND, NEAR)
def prj_25(spark, d):
    out = nearest(spark, d)
    for df, key, label in ((X.src(spark, d), "src_idx", "src"), (X.ref(spark, d), "ref_idx", "ref")):
        out = out.join(df.select(F.col("row_idx").alias(key), *[F.col(c).alias(f"{label}_{c}") for c in ("particle_id", "material")]), key)
    return out.select("src_idx", "ref_idx", "src_particle_id", "src_material", "ref_particle_id", "ref_material")


def _filter(name: str, sql: str, view: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    query(name, sql, view)(lambda spark, d: f(spark, d).select("row_idx"))


_filter("flt_1_prefilter_ftir", "SELECT row_idx FROM fx_ref WHERE x_um IS NOT NULL AND (quality IS NULL OR quality >= 0.4) AND (feret_max_um IS NULL OR feret_max_um >= 60)", X.REF, lambda s, d: L.prefilter_ftir(X.ref(s, d), 0.4, 60))
_filter("flt_2_prefilter_raman", "SELECT row_idx FROM fx_ref WHERE x_um IS NOT NULL AND quality >= 70 AND (feret_max_um IS NULL OR feret_max_um >= 60)", X.REF, lambda s, d: L.prefilter_raman(X.ref(s, d), 70, 60))
_filter("flt_3_prefilter_ldir", "SELECT row_idx FROM fx_third WHERE (quality IS NULL OR quality >= 0.6) AND (feret_max_um IS NULL OR feret_max_um >= 60)", X.THIRD, lambda s, d: L.prefilter_ldir(X.third(s, d), 0.6, 60))
_filter("flt_4_anchors", "SELECT row_idx FROM fx_ref WHERE regexp_matches(material, 'Polyethylene terephtalate|Polypropylene', 'i')", X.REF, lambda s, d: L.anchors(X.ref(s, d), Config().raman_anchors))
_filter("flt_5_anchors_or_all", "SELECT row_idx FROM fx_third", X.THIRD, lambda s, d: L.anchors_or_all(X.third(s, d), ("no such material",)))
_filter("flt_5_anchors", "SELECT row_idx FROM fx_third WHERE regexp_matches(material, 'Polyethylene terephthalate|Polypropylene|Polycarbonate', 'i') OR (SELECT count(*) FROM fx_third WHERE regexp_matches(material, 'Polyethylene terephthalate|Polypropylene|Polycarbonate', 'i')) < 4", X.THIRD, lambda s, d: L.anchors_or_all(X.third(s, d), Config().ldir_anchors))
_filter("flt_6_anchor_gate", "SELECT row_idx FROM fx_ref WHERE (feret_max_um IS NULL OR feret_max_um >= 20) AND quality >= 70", X.REF, lambda s, d: L.anchor_gate(X.ref(s, d)))
_filter("flt_7_spatial_set", "SELECT row_idx FROM fx_ref WHERE feret_max_um IS NULL OR feret_max_um >= 20", X.REF, lambda s, d: X.ref(s, d).filter(L.at_least_or_unknown(F.col("feret_max_um"), 20)))
_filter("flt_8_landmarks", "SELECT row_idx FROM fx_ref WHERE feret_max_um >= 100 OR (major_um / minor_um >= 3 AND feret_max_um >= 100)", X.REF, lambda s, d: L.landmarks(X.ref(s, d)))
_filter("flt_15_adaptive", "SELECT row * 64 + col AS row_idx FROM (SELECT row, col, value, sum(s) OVER w / sum(n) OVER w AS local FROM (SELECT row, col, value, sum(value) OVER v AS s, count(*) OVER v AS n FROM fx_pixels WINDOW v AS (PARTITION BY row ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WINDOW w AS (PARTITION BY col ORDER BY row ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE abs(value - local) > 25", X.PIXELS, lambda s, d: imaging.box_mean(X.pixels(s, d), 5).filter(F.abs(F.col("value") - F.col("local")) > 25).select((F.col("row") * 64 + F.col("col")).alias("row_idx")))
_filter("flt_16_saturation", "SELECT row * 64 + col AS row_idx FROM (SELECT *, value / 255 AS a, value / 510 AS b FROM fx_pixels) WHERE CASE WHEN a > 0 THEN (a - b) / a ELSE 0 END > 0.3 AND a > 0.08", X.PIXELS, lambda s, d: X.pixels(s, d).filter(imaging.is_saturated(F.col("value") / 255, F.col("value") / 510, F.col("value") / 510)).select((F.col("row") * 64 + F.col("col")).alias("row_idx")))
_filter("flt_17_threshold", "SELECT row * 64 + col AS row_idx FROM fx_pixels WHERE value > 25", X.PIXELS, lambda s, d: X.pixels(s, d).filter("value > 25").select((F.col("row") * 64 + F.col("col")).alias("row_idx")))
_filter("flt_19_view_filter", "SELECT row_idx FROM fx_ref WHERE quality BETWEEN 20 AND 90 AND feret_max_um BETWEEN 50 AND 200 AND material IN ('Polypropylene (PP)', 'Polycarbonate (PC)')", X.REF, lambda s, d: L.instrument_view(X.ref(s, d), (20, 90), (50, 200), ["Polypropylene (PP)", "Polycarbonate (PC)"]))
_filter("flt_21_finite", "SELECT row_idx FROM fx_ref WHERE x_um IS NOT NULL AND isfinite(x_um)", X.REF, lambda s, d: X.ref(s, d).filter(L.finite(F.col("x_um"))))


@query("flt_10_pair_distance", "SELECT src_idx, ref_idx FROM cand WHERE d <= 40 AND rank <= 20", *BASE, CAND)
def flt_10(spark, d):
    return cands(spark, d).filter("d <= 40").select("src_idx", "ref_idx")


@query("flt_20_overlay", "SELECT n.src_idx FROM near n JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx WHERE r.quality BETWEEN 10 AND 100 AND s.quality BETWEEN 0.1 AND 1 AND n.match_distance BETWEEN 0 AND 60 AND (s.feret_max_um BETWEEN 50 AND 200 OR r.feret_max_um BETWEEN 50 AND 200)", *BASE, CAND, NEAR)
def flt_20(spark, d):
    side = lambda df, k, p: df.select(F.col("row_idx").alias(k), F.col("quality").alias(f"{p}q"), F.col("feret_max_um").alias(f"{p}f"))
    m = nearest(spark, d).join(side(X.src(spark, d), "src_idx", "s"), "src_idx").join(side(X.ref(spark, d), "ref_idx", "r"), "ref_idx")
    return m.filter(F.col("rq").between(10, 100) & F.col("sq").between(0.1, 1) & F.col("match_distance").between(0, 60) & (F.col("sf").between(50, 200) | F.col("rf").between(50, 200))).select("src_idx")


ALLD = "alld AS (SELECT s.row_idx AS src_idx, r.row_idx AS ref_idx, sqrt((s.x_aligned - r.x_norm) * (s.x_aligned - r.x_norm) + (s.y_aligned - r.y_norm) * (s.y_aligned - r.y_norm)) AS d FROM src_al s, fx_ref r WHERE r.x_norm IS NOT NULL)"


def _close(spark, d, radius):
    left = aligned(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))
    right = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    return spatial.within(left, right, radius, radius)


@query("jn_1_nearest", "SELECT src_idx, ref_idx, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY d, ref_idx) AS k FROM alld WHERE d <= 500) WHERE k = 1", *BASE, ALLD)
def jn_1(spark, d):
    return rounded(spatial.nearest(_close(spark, d, 500)))


@query("jn_2_knn_candidates", "SELECT src_idx, ref_idx, round(d, 6) AS d, rank FROM cand WHERE rank <= 20", *BASE, CAND)
def jn_2(spark, d):
    return cands(spark, d).select("src_idx", "ref_idx", r6("d").alias("d"), F.col("rank").cast("long").alias("rank"))


@query("jn_3_mutual", "SELECT f.src_idx, f.ref_idx, round(f.d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY d, ref_idx) AS k, row_number() OVER (PARTITION BY ref_idx ORDER BY d, src_idx) AS j FROM alld WHERE d <= 500) f WHERE k = 1 AND j = 1", *BASE, ALLD)
def jn_3(spark, d):
    return rounded(spatial.mutual(_close(spark, d, 500)).select("src_idx", "ref_idx", "d"))


@query("jn_4_inliers", "SELECT count(DISTINCT src_idx) AS n FROM alld WHERE d <= 25", *BASE, ALLD)
def jn_4(spark, d):
    left = aligned(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))
    right = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    return spatial.inliers(left, right, 25).agg(F.count("*").alias("n"))


@query("jn_7_unmatched", "SELECT row_idx FROM fx_ref WHERE row_idx NOT IN (SELECT ref_idx FROM near)", *BASE, CAND, NEAR)
def jn_7(spark, d):
    return X.ref(spark, d).select("row_idx").join(nearest(spark, d), F.col("row_idx") == F.col("ref_idx"), "left_anti")


T3 = X.PLANTED_THIRD
THIRD_AL = f"third_al AS (SELECT *, {T3.a!r} * x_norm - {T3.b!r} * y_norm + ({T3.tx!r}) AS x_aligned, {T3.b!r} * x_norm + {T3.a!r} * y_norm + ({T3.ty!r}) AS y_aligned FROM fx_third)"
NEAR3 = "near3 AS (SELECT third_idx, ref_idx, d FROM (SELECT *, row_number() OVER (PARTITION BY third_idx ORDER BY d, ref_idx) AS k FROM (SELECT s.row_idx AS third_idx, r.row_idx AS ref_idx, sqrt((s.x_aligned - r.x_norm) * (s.x_aligned - r.x_norm) + (s.y_aligned - r.y_norm) * (s.y_aligned - r.y_norm)) AS d, greatest(100.0::DOUBLE, 0.15 * coalesce(s.major_um, 0)) AS t FROM third_al s, fx_ref r WHERE r.x_norm IS NOT NULL) WHERE d <= t) WHERE k = 1)"


def _triplets(spark, d):
    lr = matching.candidates(G.aligned(X.third(spark, d), T3), X.ref(spark, d)).filter("rank = 1").select(F.col("src_idx").alias("third_idx"), "ref_idx")
    return matching.triplets(nearest(spark, d).select("src_idx", "ref_idx"), lr)


@query("jn_8_triplets", "SELECT src_idx, ref_idx, third_idx FROM near JOIN near3 USING (ref_idx)", *BASE, CAND, NEAR, X.THIRD, THIRD_AL, NEAR3)
def jn_8(spark, d):
    return _triplets(spark, d).select("src_idx", "ref_idx", "third_idx")


FAM3 = ", ".join(f"{M.family_sql(f'{k}_material')} AS {k}_family" for k in ("ftir", "raman", "ldir"))
CONS = """SELECT src_idx, ref_idx, third_idx, ftir_family, raman_family, ldir_family, n AS n_instrument_agreement, CASE WHEN n = 3 THEN 'All agree' WHEN fr = 1 THEN 'FTIR-Raman' WHEN lr = 1 THEN 'LDIR-Raman' WHEN fl = 1 THEN 'FTIR-LDIR' ELSE 'None' END AS material_consensus FROM (SELECT *, fr + lr + fl AS n FROM (SELECT *, (ftir_family = raman_family AND ftir_family <> 'Unknown')::INT AS fr, (ldir_family = raman_family AND ldir_family <> 'Unknown')::INT AS lr, (ftir_family = ldir_family AND ftir_family <> 'Unknown')::INT AS fl FROM fam3))"""


@query("str_8_consensus", CONS, *BASE, CAND, NEAR, X.THIRD, THIRD_AL, NEAR3, f"fam3 AS (SELECT *, {FAM3} FROM (SELECT n.src_idx, n.ref_idx, m.third_idx, s.material AS ftir_material, r.material AS raman_material, t.material AS ldir_material FROM near n JOIN near3 m USING (ref_idx) JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx JOIN fx_third t ON t.row_idx = m.third_idx))")
def str_8(spark, d):
    t = _triplets(spark, d)
    for df, key, label in ((X.src(spark, d), "src_idx", "ftir"), (X.ref(spark, d), "ref_idx", "raman"), (X.third(spark, d), "third_idx", "ldir")):
        t = t.join(df.select(F.col("row_idx").alias(key), F.col("material").alias(f"{label}_material")), key)
    return A.three_way(t).select("src_idx", "ref_idx", "third_idx", "ftir_family", "raman_family", "ldir_family", "n_instrument_agreement", "material_consensus")


AMB = "amb AS (SELECT n.src_idx, n.match_distance, count(*) FILTER (a.d <= 50) AS c, min(a.d) FILTER (a.ref_idx <> n.ref_idx) AS b FROM near n JOIN alld a ON a.src_idx = n.src_idx GROUP BY n.src_idx, n.match_distance)"


@query("jn_10_ambiguity", "SELECT src_idx, c AS n_ref_candidates, round(b, 6) AS next_best_distance, round(CASE WHEN b > 0 THEN match_distance / b ELSE 0 END, 6) AS ambiguity_score, (CASE WHEN b > 0 THEN match_distance / b ELSE 0 END) > 0.7 OR c >= 3 AS ambiguity_flag FROM amb", *BASE, CAND, NEAR, ALLD, AMB)
def jn_10(spark, d):
    m = nearest(spark, d)
    return rounded(matching.ambiguity(m, aligned(spark, d), X.ref(spark, d)))


@query("jn_11_composites", """SELECT src_particle_id, count(*) AS n_ref_parts, string_agg(ref_id, ';' ORDER BY ref_idx) AS ref_ids, round(sum(ra), 6) AS combined_area, round(any_value(sa), 6) AS src_area, round(sum(ra) / any_value(sa), 3) AS area_ratio FROM (
 SELECT s.particle_id AS src_particle_id, s.row_idx AS src_idx, r.row_idx AS ref_idx, r.particle_id AS ref_id, r.area_um2 AS ra, s.area_um2 AS sa, sqrt((s.x_aligned - r.x_norm) * (s.x_aligned - r.x_norm) + (s.y_aligned - r.y_norm) * (s.y_aligned - r.y_norm)) AS d, CASE WHEN s.major_um > 0 THEN 1.5 * s.major_um / 2 ELSE 100 END AS rad
 FROM src_al s, fx_ref r WHERE r.x_norm IS NOT NULL AND s.area_um2 > 0 AND r.row_idx NOT IN (SELECT ref_idx FROM near)) WHERE d <= rad GROUP BY src_idx, src_particle_id HAVING count(*) >= 2 AND sum(ra) > 0 AND sum(ra) / any_value(sa) BETWEEN 0.3 AND 5""", *BASE, CAND, NEAR)
def jn_11(spark, d):
    ref, taken = X.ref(spark, d), nearest(spark, d).select(F.col("ref_idx").alias("row_idx"))
    return rounded(matching.composites(aligned(spark, d), ref.join(taken, "row_idx", "left_anti")))


@query("jn_15_size_join")
def jn_15(spark, d):
    return rounded(matching.size_join(X.third(spark, d), X.src(spark, d))).select("row_idx", "x_um", "y_um", "coord_match_cost", "coord_source")


@query("asg_1_optimal")
def asg_1(spark, d):
    return rounded(matching.optimal(cands(spark, d)))


@query("asg_2_greedy")
def asg_2(spark, d):
    edges = matching.candidates(aligned(spark, d), X.ref(spark, d), k=5)
    return rounded(matching.greedy(edges).select("src_idx", "ref_idx", "score"))


@query("asg_3_match")
def asg_3(spark, d):
    return rounded(matching.match(aligned(spark, d), X.ref(spark, d)).matched)


@query("agg_1_match_stats", "SELECT (SELECT count(*) FROM fx_src) AS n_src, (SELECT count(*) FROM fx_ref) AS n_ref, count(*) AS n_matched, (SELECT count(*) FROM fx_src) - count(*) AS n_unmatched_src, (SELECT count(*) FROM fx_ref) - count(*) AS n_unmatched_ref, round(count(*) / (SELECT count(*) FROM fx_src), 6) AS src_rate, round(count(*) / (SELECT count(*) FROM fx_ref), 6) AS ref_rate, round(avg(match_distance), 6) AS mean_distance, round(median(match_distance), 6) AS median_distance, round(max(match_distance), 6) AS max_distance FROM near", *BASE, CAND, NEAR)
def agg_1(spark, d):
    return rounded(matching.stats(nearest(spark, d), X.src(spark, d), X.ref(spark, d)))


MOM = "pairs AS (SELECT s.x_norm px, s.y_norm py, r.x_norm qx, r.y_norm qy FROM near n JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx)"


def _fit_pairs(spark, d):
    s = X.src(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("x_norm").alias("px"), F.col("y_norm").alias("py"))
    r = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("qx"), F.col("y_norm").alias("qy"))
    return nearest(spark, d).join(s, "src_idx").join(r, "ref_idx")


@query("fit_1_similarity", "SELECT n, round(a, 6) AS a, round(b, 6) AS b, round(mqx - (a * mpx - b * mpy), 4) AS tx, round(mqy - (b * mpx + a * mpy), 4) AS ty FROM (SELECT count(*) AS n, sum((px - mpx) * (qx - mqx) + (py - mpy) * (qy - mqy)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS a, sum((px - mpx) * (qy - mqy) - (py - mpy) * (qx - mqx)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS b, any_value(mpx) mpx, any_value(mpy) mpy, any_value(mqx) mqx, any_value(mqy) mqy FROM (SELECT *, avg(px) OVER () mpx, avg(py) OVER () mpy, avg(qx) OVER () mqx, avg(qy) OVER () mqy FROM pairs))", *BASE, CAND, NEAR, MOM)
def fit_1(spark, d):
    f = fit.solved(fit.moments(_fit_pairs(spark, d)))
    return f.select("n", F.round("p_a", 6).alias("a"), F.round("p_b", 6).alias("b"), F.round("p_tx", 4).alias("tx"), F.round("p_ty", 4).alias("ty"))


def _transform_row(spark, t: G.Transform, **more):
    row = {"a": round(float(t.a), 6), "b": round(float(t.b), 6), "tx": round(float(t.tx), 3), "ty": round(float(t.ty), 3), "reflected": t.reflected} | more
    return spark.createDataFrame([row])


def _clouds(spark, d):
    s = X.src(spark, d).select(F.col("row_idx").alias("src_idx"), "x_norm", "y_norm", "major_um", "minor_um", "feret_max_um", "material")
    r = X.ref(spark, d).filter("x_norm is not null").select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"), "major_um", "minor_um", "feret_max_um", "material")
    return s, r


@query("fit_2_coarse")
def fit_2(spark, d):
    s, r = _clouds(spark, d)
    t, n = fit.coarse(L.anchors(s, ("PET",)), L.anchors(r, ("tereph",)), Config(coarse_step_deg=4.0))
    return _transform_row(spark, t, n_inliers=n)


@query("fit_3_ransac")
def fit_3(spark, d):
    s, r = _clouds(spark, d)
    t, n = fit.ransac(L.anchors(s, ("PET",)), L.anchors(r, ("tereph",)), Config(coarse_step_deg=4.0, ransac_iterations=300))
    return _transform_row(spark, t, n_inliers=n)


@query("fit_5_landmark")
def fit_5(spark, d):
    s, r = _clouds(spark, d)
    found = fit.landmark(L.landmarks(s, 330), L.landmarks(r, 330), Config(coarse_step_deg=4.0, ransac_iterations=300))
    return _transform_row(spark, *((found[0],) if found else (G.Transform(),)), confident=bool(found and found[1]))


@query("fit_6_icp")
def fit_6(spark, d):
    s, r = _clouds(spark, d)
    t, history, done = fit.icp(s, r, G.Transform(T.a, T.b, T.tx + 40, T.ty - 30))
    return _transform_row(spark, t, iterations=len(history), rms=round(history[-1], 4), converged=done)


@query("fit_9_verdict", "SELECT CASE WHEN third > 100 THEN 'POOR' WHEN third > 3 * own THEN 'MARGINAL' ELSE 'GOOD' END AS verdict FROM (SELECT (SELECT sqrt(avg(d * d)) FROM near3) AS third, (SELECT sqrt(avg(match_distance * match_distance)) FROM near) AS own)", *BASE, CAND, NEAR, X.THIRD, THIRD_AL, NEAR3)
def fit_9(spark, d):
    rms = lambda df, c, name: df.agg(F.sqrt(F.avg(F.col(c) * F.col(c))).alias(name))
    third = matching.candidates(G.aligned(X.third(spark, d), T3), X.ref(spark, d)).filter("rank = 1")
    both = rms(third, "d", "third").crossJoin(rms(nearest(spark, d), "match_distance", "own"))
    return both.select(fit.verdict(F.col("third"), F.col("own")).alias("verdict"))


@query("win_3_trim", "SELECT src_idx FROM near WHERE match_distance <= (SELECT max(match_distance) FROM (SELECT match_distance, row_number() OVER (ORDER BY match_distance, src_idx) AS k FROM near) WHERE k <= (SELECT count(*) - floor(0.1 * count(*)) FROM near))", *BASE, CAND, NEAR)
def win_3(spark, d):
    n = nearest(spark, d).withColumnRenamed("match_distance", "d")
    return fit.trim_cutoff(n, 0.1).select("src_idx")


@query("str_1_normal_name", f"SELECT id, {M.normal_sql('name')} AS norm FROM fx_names WHERE name IS NOT NULL", X.NAMES)
def str_1(spark, d):
    return X.names(spark, d).filter("name is not null").select("id", M.normal_name(F.col("name")).alias("norm"))


@query("str_2_family", f"SELECT id, family, {M.category_sql('family')} AS category FROM (SELECT id, {M.family_sql('name')} AS family FROM fx_names)", X.NAMES)
def str_2(spark, d):
    out = X.names(spark, d).select("id", M.family(F.col("name")).alias("family"))
    return out.select("id", "family", M.category(F.col("family")).alias("category"))


@query("str_5_tier", "SELECT match_id, tier FROM graded", X.EVENTS, GRADED_EVENTS)
def str_5(spark, d):
    return X.events_pairs(spark, d).select("match_id", M.tier(F.col("material_a"), F.col("material_b")).alias("tier"))


@query("str_6_mapped", "SELECT id, CASE WHEN regexp_matches(trim(name), 'poly', 'i') THEN 'POLYMER' WHEN regexp_matches(trim(name), '^pet$', 'i') THEN 'POLYMER' ELSE upper(trim(name)) END AS name FROM fx_names", X.NAMES)
def str_6(spark, d):
    return X.names(spark, d).select("id", M.mapped(F.col("name"), {"poly": "Polymer", "^pet$": "Polymer"}).alias("name"))


@query("str_9_digits", "SELECT row_idx, TRY_CAST(regexp_replace(particle_id, '[^0-9]', '', 'g') AS DOUBLE) AS number FROM fx_ref", X.REF)
def str_9(spark, d):
    return X.ref(spark, d).select("row_idx", S.digits(F.col("particle_id")).alias("number"))


@query("agg_2_agreement", f"SELECT *, {SHARES} FROM (SELECT {TIERS}, round(avg(agree_exact::INT), 6) AS agreement_rate FROM graded)", X.PAIRS, GRADED_PAIRS)
def agg_2(spark, d):
    return A.summary(graded(spark, d, X.pairs)).withColumn("agreement_rate", r6("agreement_rate"))


@query("agg_4_agreement_detail", f"SELECT material_a, family_a, {M.category_sql('family_a')} AS category_a, n_pairs, n_exact, n_family, n_disagree, {SHARES} FROM (SELECT *, {M.family_sql('material_a')} AS family_a FROM (SELECT material_a_norm AS material_a, {TIERS} FROM graded GROUP BY material_a_norm))", X.PAIRS, GRADED_PAIRS)
def agg_4(spark, d):
    return A.detail(graded(spark, d, X.pairs))


@query("agg_5_category", f"SELECT *, {SHARES} FROM (SELECT category_a AS category, {TIERS} FROM graded GROUP BY category_a)", X.PAIRS, GRADED_PAIRS)
def agg_5(spark, d):
    return A.by_category(graded(spark, d, X.pairs))


BINS = "bins AS (SELECT * FROM (VALUES (0, '[0,50)', 0, 50), (1, '[50,100)', 50, 100), (2, '[100,200)', 100, 200), (3, '[200,300)', 200, 300), (4, '[300,Inf)', 300, 1e300)) AS b(ord, size_class, lo, hi))"


@query("agg_6_size_classes", "SELECT size_class, count(tier) AS n_pairs, round_even(100.0::DOUBLE * count(*) FILTER (tier = 'Exact') / nullif(count(tier), 0), 1) AS exact_pct, round_even(100.0::DOUBLE * count(*) FILTER (tier IN ('Exact', 'Family')) / nullif(count(tier), 0), 1) AS family_or_better_pct FROM bins LEFT JOIN graded ON feret >= lo AND feret < hi GROUP BY size_class", X.PAIRS, GRADED_PAIRS, BINS)
def agg_6(spark, d):
    return A.by_size(graded(spark, d, X.pairs), "feret")


@query("agg_7_confusion", "SELECT a.family_a, b.family_b, count(g.tier) AS n FROM (SELECT DISTINCT family_a FROM graded) a CROSS JOIN (SELECT DISTINCT family_b FROM graded) b LEFT JOIN graded g ON g.family_a = a.family_a AND g.family_b = b.family_b GROUP BY 1, 2", X.EVENTS, GRADED_EVENTS)
def agg_7(spark, d):
    return A.confusion(graded(spark, d))


@query("agg_9_distribution", "SELECT material, count(*) AS n FROM fx_ref WHERE material IS NOT NULL GROUP BY material", X.REF)
def agg_9(spark, d):
    return A.distribution(X.ref(spark, d))


@query("agg_11_tps", """SELECT quad, count(*) AS n, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy FROM (SELECT CASE WHEN y > my THEN 'T' ELSE 'B' END || CASE WHEN x > mx THEN 'R' ELSE 'L' END AS quad, dx, dy FROM (SELECT r.x_norm AS x, r.y_norm AS y, r.x_norm - s.x_aligned AS dx, r.y_norm - s.y_aligned AS dy, median(r.x_norm) OVER () AS mx, median(r.y_norm) OVER () AS my FROM near n JOIN src_al s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx)) GROUP BY quad""", *BASE, CAND, NEAR)
def agg_11(spark, d):
    from quern.operators.diagnostics import quadrants

    return rounded(quadrants(_residuals(spark, d)))


def _residuals(spark, d):
    s = aligned(spark, d).select(F.col("row_idx").alias("src_idx"), "x_aligned", "y_aligned")
    r = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    return nearest(spark, d).join(s, "src_idx").join(r, "ref_idx").select("src_idx", "x", "y", "match_distance", (F.col("x") - F.col("x_aligned")).alias("dx"), (F.col("y") - F.col("y_aligned")).alias("dy"))


@query("agg_15_scan_order", "SELECT n, round((c - q)::DOUBLE / sqrt((n * (n - 1) / 2 - ta) * (n * (n - 1) / 2 - tb)), 6) AS tau FROM (SELECT (SELECT count(*) FROM e) AS n, count(*) FILTER (sign(a.p - b.p) * sign(a.q - b.q) > 0) AS c, count(*) FILTER (sign(a.p - b.p) * sign(a.q - b.q) < 0) AS q, count(*) FILTER (a.p = b.p) AS ta, count(*) FILTER (a.q = b.q) AS tb FROM e a JOIN e b ON a.i < b.i)", "e AS (SELECT event_id AS i, event_id % 97 AS p, value::DOUBLE AS q FROM events)")
def agg_15(spark, d):
    from quern.operators.diagnostics import kendall

    e = X.table(spark, d, "events").select(F.col("event_id").alias("i"), (F.col("event_id") % 97).alias("p"), F.col("value").cast("double").alias("q"))
    return rounded(kendall(e))


@query("agg_16_bounds", "SELECT round(coalesce(min(x_um) - 200, -1000), 6) AS x_min, round(coalesce(max(x_um) + 200, 1000), 6) AS x_max, round(coalesce(min(y_um) - 200, -1000), 6) AS y_min, round(coalesce(max(y_um) + 200, 1000), 6) AS y_max FROM fx_ref", X.REF)
def agg_16(spark, d):
    from quern.operators.viewer import bounds

    return rounded(bounds(X.ref(spark, d), "x_um", "y_um"))


@query("agg_18_summary", "SELECT count(*) AS n, count(DISTINCT material) AS n_materials, count(*) FILTER (quality >= 70) AS n_good FROM fx_ref", X.REF)
def agg_18(spark, d):
    return X.ref(spark, d).agg(F.count("*").alias("n"), F.count_distinct("material").alias("n_materials"), F.count_if(F.col("quality") >= 70).alias("n_good"))


@query("agg_19_ranges", "SELECT floor(min(quality)) AS q_min, ceil(max(quality)) AS q_max, ceil(max(feret_max_um) / 10) * 10 AS size_max FROM fx_ref", X.REF)
def agg_19(spark, d):
    from quern.operators.viewer import ranges

    return ranges(X.ref(spark, d))


@query("top_1_triage", "SELECT match_id, tier, round(2 * amb + CASE WHEN tier = 'Disagree' THEN 1 ELSE 0 END + match_distance / 100, 6) AS triage_score FROM (SELECT *, (match_id % 101) / 101.0::DOUBLE AS amb FROM graded) ORDER BY 2 * amb + CASE WHEN tier = 'Disagree' THEN 1 ELSE 0 END + match_distance / 100 DESC, match_id LIMIT 50", X.EVENTS, GRADED_EVENTS)
def top_1(spark, d):
    g = graded(spark, d).withColumn("ambiguity_score", (F.col("match_id") % 101) / F.lit(101.0))
    return A.triage(g).select("match_id", "tier", r6("triage_score").alias("triage_score"))


@query("top_4_auto_trim", "SELECT row_idx FROM fx_ref WHERE area_um2 >= (SELECT min(area_um2) FROM (SELECT area_um2 FROM fx_ref ORDER BY area_um2 DESC NULLS LAST LIMIT 130))", X.REF)
def top_4(spark, d):
    return imaging.auto_trim(X.ref(spark, d), 100, "area_um2").select("row_idx")


@query("top_6_nearest_to_cursor", "SELECT row_idx, round(d, 6) AS d FROM (SELECT row_idx, sqrt((x_um - 100) * (x_um - 100) + (y_um + 50) * (y_um + 50)) AS d FROM fx_ref WHERE x_um IS NOT NULL ORDER BY 2, 1 LIMIT 1)", X.REF)
def top_6(spark, d):
    from quern.operators.viewer import nearest_to

    return rounded(nearest_to(X.ref(spark, d), 100.0, -50.0, "x_um", "y_um").select("row_idx", "d"))


@query("set_1_union_status", "SELECT s.row_idx, CASE WHEN n.src_idx IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status FROM fx_src s LEFT JOIN near n ON n.src_idx = s.row_idx", *BASE, CAND, NEAR)
def set_1(spark, d):
    from quern.operators.viewer import with_status

    return with_status(X.src(spark, d), nearest(spark, d).select("src_idx"), "src_idx").select("row_idx", "match_status")


@query("set_4_materials", "SELECT DISTINCT material FROM (SELECT material FROM fx_ref UNION ALL SELECT material FROM fx_src UNION ALL SELECT material FROM fx_third) WHERE material IS NOT NULL", X.REF, X.SRC, X.THIRD)
def set_4(spark, d):
    every = [f(spark, d).select("material") for f in (X.ref, X.src, X.third)]
    return every[0].unionByName(every[1]).unionByName(every[2]).filter("material is not null").distinct()


@query("set_6_tiers_long", f"UNPIVOT (SELECT category_a AS category, count(*) FILTER (tier = 'Exact') AS \"Exact\", count(*) FILTER (tier = 'Family') AS \"Family\", count(*) FILTER (tier = 'Disagree') AS \"Disagree\" FROM graded GROUP BY category_a) ON \"Exact\", \"Family\", \"Disagree\" INTO NAME tier VALUE n".replace("UNPIVOT", "SELECT * FROM (UNPIVOT") + ")", X.PAIRS, GRADED_PAIRS)
def set_6(spark, d):
    return A.tiers_long(A.by_category(graded(spark, d, X.pairs)), "category")


@query("win_5_integral", "SELECT row, col, round(sum(c) OVER (PARTITION BY row ORDER BY col), 4) AS integral FROM (SELECT row, col, sum(value) OVER (PARTITION BY col ORDER BY row) AS c FROM fx_pixels)", X.PIXELS)
def win_5(spark, d):
    return imaging.integral(X.pixels(spark, d)).select("row", "col", F.round("integral", 4).alias("integral"))


@query("win_6_box_filter", "SELECT row, col, round(sum(s) OVER w / sum(n) OVER w, 6) AS local FROM (SELECT row, col, sum(value) OVER v AS s, count(*) OVER v AS n FROM fx_pixels WINDOW v AS (PARTITION BY row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WINDOW w AS (PARTITION BY col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", X.PIXELS)
def win_6(spark, d):
    return imaging.box_mean(X.pixels(spark, d), 3).select("row", "col", r6("local").alias("local"))


@query("img_2_downsample", "SELECT row // 4 AS row, col // 4 AS col, round(value, 6) AS value FROM fx_pixels WHERE row % 4 = 0 AND col % 4 = 0", X.PIXELS)
def img_2(spark, d):
    return rounded(imaging.downsampled(X.pixels(spark, d), 4))


CCL = """fg AS (SELECT row, col, row * 64 + col AS id, value FROM fx_pixels WHERE value > 40), reach(id, seen) AS (SELECT id, id FROM fg UNION SELECT f.id, r.seen FROM reach r JOIN fg g ON g.id = r.id JOIN fg f ON (f.row = g.row AND abs(f.col - g.col) = 1) OR (f.col = g.col AND abs(f.row - g.row) = 1)), lab AS (SELECT id, min(seen) AS label FROM reach GROUP BY id)"""
RECURSIVE = X.sql("SELECT f.row, f.col, l.label FROM fg f JOIN lab l USING (id)", X.PIXELS, CCL).replace("WITH", "WITH RECURSIVE", 1)
PROPS = X.sql("SELECT label, count(*) AS area_px, round(avg(row), 6) AS centroid_y, round(avg(col), 6) AS centroid_x, max(row) - min(row) + 1 AS bbox_height, max(col) - min(col) + 1 AS bbox_width, round(max(value), 6) AS max_intensity, round(avg(value), 6) AS mean_intensity, round(sum(value), 6) AS integrated_intensity, round(2 * sqrt(count(*) / pi()), 6) AS equivalent_diameter, round(greatest(max(row) - min(row), max(col) - min(col)) + 1.0::DOUBLE, 6) / least(max(row) - min(row) + 1, max(col) - min(col) + 1) AS aspect_ratio FROM fg JOIN lab USING (id) GROUP BY label", X.PIXELS, CCL).replace("WITH", "WITH RECURSIVE", 1)


def _foreground(spark, d):
    return X.pixels(spark, d).filter("value > 40")


@query("img_4_components")
def img_4(spark, d):
    return imaging.components(_foreground(spark, d), 64)


@query("agg_13_properties")
def agg_13(spark, d):
    fg = _foreground(spark, d)
    return rounded(imaging.properties(imaging.components(fg, 64).join(fg, ["row", "col"])))


ORACLES["img_4_components"], ORACLES["agg_13_properties"] = RECURSIVE, PROPS.replace("round(greatest(max(row) - min(row), max(col) - min(col)) + 1.0::DOUBLE, 6) / least(max(row) - min(row) + 1, max(col) - min(col) + 1)", "round((greatest(max(row) - min(row), max(col) - min(col)) + 1.0::DOUBLE) / least(max(row) - min(row) + 1, max(col) - min(col) + 1), 6)")


def _height(spark, d):
    return X.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


@query("img_6_background")
def img_6(spark, d):
    return rounded(imaging.corrected(X.pixels(spark, d), _height(spark, d), 64, 4, 1), 4)


@query("img_8_auto_threshold")
def img_8(spark, d):
    return spark.createDataFrame([(imaging.tuned_threshold(X.pixels(spark, d), 64, 300, 2),)], "threshold double")


@query("dia_3_distance_histogram", "SELECT least(floor((match_distance - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM (SELECT match_distance, min(match_distance) OVER () AS lo, (max(match_distance) OVER () - min(match_distance) OVER ()) / 30 AS w FROM near) GROUP BY 1", *BASE, CAND, NEAR)
def dia_3(spark, d):
    from quern.operators.diagnostics import histogram

    return histogram(nearest(spark, d), "match_distance", 30)


@query("dia_5_residuals", "SELECT n.src_idx, round(r.x_norm - s.x_aligned, 6) AS dx, round(r.y_norm - s.y_aligned, 6) AS dy FROM near n JOIN src_al s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx", *BASE, CAND, NEAR)
def dia_5(spark, d):
    return rounded(_residuals(spark, d).select("src_idx", "dx", "dy"))


@query("dia_6_vectors", "SELECT n.src_idx, round(r.x_norm, 6) AS x, round(r.y_norm, 6) AS y, round(r.x_norm + 5 * (r.x_norm - s.x_aligned), 6) AS xend, round(r.y_norm + 5 * (r.y_norm - s.y_aligned), 6) AS yend FROM near n JOIN src_al s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx", *BASE, CAND, NEAR)
def dia_6(spark, d):
    from quern.operators.diagnostics import vectors

    return rounded(vectors(_residuals(spark, d), 5.0).select("src_idx", "x", "y", "xend", "yend"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reference object is each source object, and how do their materials agree?"""
    m = nearest(spark, sf_dir)
    s = X.src(spark, sf_dir).select(F.col("row_idx").alias("src_idx"), F.col("material").alias("material_a"))
    r = X.ref(spark, sf_dir).select(F.col("row_idx").alias("ref_idx"), F.col("material").alias("material_b"))
    return A.paired(m.join(s, "src_idx").join(r, "ref_idx")).select("src_idx", "ref_idx", r6("match_distance").alias("match_distance"), "family_a", "family_b", "tier")
