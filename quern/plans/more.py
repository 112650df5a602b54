"""Further queries of the catalog: conversions, look-ups, gates, viewer and extension operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geometry as G
from quern.functions import materials as M
from quern.operators import agreement as A
from quern.operators import calibrate as K
from quern.operators import diagnostics as D
from quern.operators import filters as L
from quern.operators import fit, imaging, matching, viewer
from quern.operators import normalize as N
from quern.plans import catalog as C
from quern.plans import fixtures as X
from quern.plans.catalog import ALLD, AMB, BASE, CAND, GRADED_EVENTS, GRADED_PAIRS, NEAR, query, rounded

RESID = "resid AS (SELECT n.src_idx, n.match_distance, r.x_norm AS x, r.y_norm AS y, s.x_aligned, s.y_aligned FROM near n JOIN src_al s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx)"


@query("prj_8_ldir_centroid", "SELECT row_idx, round(x_um - avg(x_um) OVER (), 6) AS x_norm, round(y_um - avg(y_um) OVER (), 6) AS y_norm FROM fx_third", X.THIRD)
def prj_8(spark, d):
    t = X.third(spark, d).select("row_idx", "x_um", "y_um")
    return rounded(N.by_centroid(t, N.centroid(t.filter("x_um is not null"))).select("row_idx", "x_norm", "y_norm"))


@query("prj_13_compose", f"SELECT row_idx, round({C.T.a!r} * x_norm + {C.T.b!r} * y_norm + {C.T.tx!r}, 5) AS x, round({C.T.b!r} * x_norm - {C.T.a!r} * y_norm + ({C.T.ty!r}), 5) AS y FROM fx_src", X.SRC)
def prj_13(spark, d):
    out = G.aligned(X.src(spark, d), C.T.after(G.MIRROR_Y))
    return out.select("row_idx", F.round("x_aligned", 5).alias("x"), F.round("y_aligned", 5).alias("y"))


@query("prj_14_pixel_to_um", "SELECT row, col, round(-500 + (col + 0.5) * 2 * (1000.0::DOUBLE / 64), 6) AS x_um, round(-500 + 1000 - (row + 0.5) * 2 * (1000.0::DOUBLE / 500), 6) AS y_um FROM fx_pixels", X.PIXELS)
def prj_14(spark, d):
    p = X.pixels(spark, d)
    return rounded(p.select("row", "col", G.pixel_to_um(F.col("col") + 1, -500.0, 1000.0, 64, 2).alias("x_um"), G.pixel_to_um(F.col("row") + 1, -500.0, 1000.0, 500, 2, flip=True).alias("y_um")))


@query("prj_16_pixel_to_um_plain", "SELECT row, col, round(-500 + col * (1000.0::DOUBLE / 64), 6) AS x_um FROM fx_pixels", X.PIXELS)
def prj_16(spark, d):
    return rounded(X.pixels(spark, d).select("row", "col", G.pixel_to_um(F.col("col"), -500.0, 1000.0, 64, half=False).alias("x_um")))


@query("prj_17_scan_extent", "SELECT p_partkey AS id, round_even((p_partkey + 1)::DOUBLE / 6, 0) * 25 AS extent FROM part")
def prj_17(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.scan_extent(F.col("p_partkey").cast("double")).alias("extent"))


@query("prj_24_rebind", "SELECT row_idx, round(x_aligned, 6) AS x_norm, round(y_aligned, 6) AS y_norm FROM src_al", X.SRC, C.SRC_ALIGNED)
def prj_24(spark, d):
    return rounded(viewer.rebound(C.aligned(spark, d)).select("row_idx", "x_norm", "y_norm"))


@query("prj_26_instrument_view", "SELECT s.particle_id, round(s.x_aligned, 6) AS x, round(s.y_aligned, 6) AS y, round(s.x_um, 6) AS x_orig, round(s.y_um, 6) AS y_orig, s.material, CASE WHEN n.src_idx IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status FROM src_al s LEFT JOIN near n ON n.src_idx = s.row_idx", *BASE, CAND, NEAR)
def prj_26(spark, d):
    s = viewer.with_status(C.aligned(spark, d), C.nearest(spark, d).select("src_idx"), "src_idx")
    return rounded(s.select("particle_id", F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"), F.col("x_um").alias("x_orig"), F.col("y_um").alias("y_orig"), "material", "match_status"))


@query("prj_27_details", "SELECT row_idx, particle_id || ' | ' || coalesce(material, 'Unknown') AS label FROM fx_ref", X.REF)
def prj_27(spark, d):
    return viewer.details(X.ref(spark, d))


TWO = "two AS (SELECT a.src_idx, sqrt((ra.x_norm - rb.x_norm) ** 2 + (ra.y_norm - rb.y_norm) ** 2) / sqrt((sa.x_norm - sb.x_norm) ** 2 + (sa.y_norm - sb.y_norm) ** 2) AS scale FROM near a JOIN near b ON b.src_idx = a.src_idx + 2 JOIN fx_src sa ON sa.row_idx = a.src_idx JOIN fx_src sb ON sb.row_idx = b.src_idx JOIN fx_ref ra ON ra.row_idx = a.ref_idx JOIN fx_ref rb ON rb.row_idx = b.ref_idx)"


@query("flt_9_scale_gate", "SELECT src_idx, round(scale, 6) AS scale FROM two WHERE scale BETWEEN 0.9 AND 1.1", *BASE, CAND, NEAR, TWO)
def flt_9(spark, d):
    """Hypotheses of two tentative pairs each, rejected by their scale."""
    p = C._fit_pairs(spark, d).select("src_idx", "px", "py", "qx", "qy")
    q = p.select((F.col("src_idx") - 2).alias("src_idx"), *[F.col(c).alias(f"{c}2") for c in ("px", "py", "qx", "qy")])
    scale = F.sqrt((F.col("qx") - F.col("qx2")) ** 2 + (F.col("qy") - F.col("qy2")) ** 2) / F.sqrt((F.col("px") - F.col("px2")) ** 2 + (F.col("py") - F.col("py2")) ** 2)
    return rounded(p.join(q, "src_idx").select("src_idx", scale.alias("scale")).filter(fit.sane(F.col("scale"))))


@query("flt_11_hqi_gate", "SELECT n.src_idx FROM near n JOIN fx_ref r ON r.row_idx = n.ref_idx WHERE r.quality >= 70", *BASE, CAND, NEAR)
def flt_11(spark, d):
    good = L.known_at_least(X.ref(spark, d), "quality", 70).select(F.col("row_idx").alias("ref_idx"))
    return C.nearest(spark, d).join(good, "ref_idx", "left_semi").select("src_idx")


@query("flt_12_coordinate_gate", "SELECT count(*) >= 10 AS enough FROM fx_ref WHERE x_um IS NOT NULL", X.REF)
def flt_12(spark, d):
    return L.placed(X.ref(spark, d)).agg((F.count("*") >= 10).alias("enough"))


@query("flt_13_cost_gate", f"SELECT src_idx, ref_idx FROM cand WHERE rank <= 20 AND {C.COST} <= 60", *BASE, CAND)
def flt_13(spark, d):
    return matching.affordable(C.cands(spark, d), 60).select("src_idx", "ref_idx")


@query("flt_18_mode", "SELECT CASE WHEN avg(CASE WHEN value > 0 THEN 0.5 ELSE 0 END) > 0.15 THEN 'saturation' ELSE 'adaptive' END AS mode FROM fx_pixels", X.PIXELS)
def flt_18(spark, d):
    v = F.col("value")
    return X.pixels(spark, d).agg(F.when(F.avg(imaging.saturation(v, v / 2, v / 2)) > 0.15, "saturation").otherwise("adaptive").alias("mode"))


@query("jn_6_row_fetch", "SELECT n.src_idx, round(s.area_um2, 6) AS src_area, round(r.area_um2, 6) AS ref_area FROM near n JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx", *BASE, CAND, NEAR)
def jn_6(spark, d):
    a = X.src(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("area_um2").alias("src_area"))
    b = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("area_um2").alias("ref_area"))
    return rounded(C.nearest(spark, d).join(a, "src_idx").join(b, "ref_idx").select("src_idx", "src_area", "ref_area"))


@query("jn_9_first_hit", "SELECT n.src_idx, r.particle_id AS raman_particle_id, f.material AS raman_material FROM near n JOIN fx_ref r ON r.row_idx = n.ref_idx LEFT JOIN (SELECT particle_id, arg_min(coalesce(material, '-'), row_idx) AS material FROM fx_ref GROUP BY 1) f USING (particle_id)", *BASE, CAND, NEAR)
def jn_9(spark, d):
    ref = X.ref(spark, d)
    named = C.nearest(spark, d).join(ref.select(F.col("row_idx").alias("ref_idx"), F.col("particle_id").alias("raman_particle_id")), "ref_idx")
    return matching.first_hit(named, ref.withColumn("material", F.coalesce("material", F.lit("-"))), "raman_particle_id", "particle_id", "material", "row_idx").select("src_idx", "raman_particle_id", F.col("material").alias("raman_material"))


@query("jn_12_triage_attach", "SELECT n.src_idx, round(CASE WHEN b > 0 THEN n.match_distance / b ELSE 0 END, 6) AS ambiguity_score FROM near n LEFT JOIN amb USING (src_idx)", *BASE, CAND, NEAR, ALLD, AMB)
def jn_12(spark, d):
    m = C.nearest(spark, d)
    return rounded(m.join(matching.ambiguity(m, C.aligned(spark, d), X.ref(spark, d)).drop("match_distance"), "src_idx", "left").select("src_idx", "ambiguity_score"))


@query("jn_13_triple_highlight", "SELECT src_idx, ref_idx FROM near WHERE ref_idx IN (SELECT ref_idx FROM near3)", *BASE, CAND, NEAR, X.THIRD, C.THIRD_AL, C.NEAR3)
def jn_13(spark, d):
    return C.nearest(spark, d).join(C._triplets(spark, d).select("ref_idx").distinct(), "ref_idx", "left_semi").select("src_idx", "ref_idx")


TOPN = "ta AS (SELECT row_number() OVER (ORDER BY area_um2 DESC, row_idx) AS k, row_idx, area_um2 FROM fx_src WHERE area_um2 IS NOT NULL), tb AS (SELECT row_number() OVER (ORDER BY area_um2 DESC, row_idx) AS k, row_idx, area_um2 FROM fx_ref WHERE area_um2 IS NOT NULL)"


@query("jn_14_rank_pairs", "SELECT ta.k AS size_rank, ta.row_idx AS a_idx, tb.row_idx AS b_idx FROM ta JOIN tb USING (k) WHERE k <= 40", X.REF, X.SRC, TOPN)
def jn_14(spark, d):
    return K.rank_pairs(X.src(spark, d), X.ref(spark, d), 40).select("size_rank", "a_idx", "b_idx")


@query("ext_1_scale", "SELECT round(median(ta.area_um2 / tb.area_um2), 6) AS scale, count(*) AS n FROM ta JOIN tb USING (k) WHERE k <= 40", X.REF, X.SRC, TOPN)
def ext_1(spark, d):
    return rounded(K.scale_estimate(K.rank_pairs(X.src(spark, d), X.ref(spark, d), 40)))


@query("ext_3_match_quality", "SELECT src_idx, CASE WHEN match_distance < 5 THEN 'good' WHEN match_distance < 15 THEN 'uncertain' ELSE 'poor' END AS match_quality FROM near", *BASE, CAND, NEAR)
def ext_3(spark, d):
    return C.nearest(spark, d).select("src_idx", K.match_quality(F.col("match_distance")).alias("match_quality"))


@query("ext_5_fields", "SELECT row, col, row * 64 + CASE WHEN row % 2 = 1 THEN 63 - col ELSE col END AS field FROM fx_pixels", X.PIXELS)
def ext_5(spark, d):
    return X.pixels(spark, d).select("row", "col", K.field_number(F.col("row"), F.col("col"), 64).alias("field"))


@query("ext_6_quality_checks", "SELECT CASE WHEN rate >= 0.8 THEN 'PASS' WHEN rate >= 0.4 THEN 'WARN' ELSE 'FAIL' END AS match_rate, CASE WHEN d <= 30 THEN 'PASS' WHEN d <= 60 THEN 'WARN' ELSE 'FAIL' END AS distance, CASE WHEN r = n THEN 'PASS' WHEN n / r > 0.5 THEN 'WARN' ELSE 'FAIL' END AS unmatched FROM (SELECT count(*) AS n, count(*) / (SELECT count(*) FROM fx_src) AS rate, avg(match_distance) AS d, (SELECT count(*) FROM fx_ref) AS r FROM near)", *BASE, CAND, NEAR)
def ext_6(spark, d):
    return K.quality_checks(matching.stats(C.nearest(spark, d), X.src(spark, d), X.ref(spark, d)))


@query("ext_6_match_checks", "SELECT unnest(['Count match', 'Match quality distribution', 'Size correlation', 'Unmatched particles']) AS \"check\", unnest([CASE WHEN abs(det - listed) = 0 THEN 'PASS' WHEN abs(det - listed) <= 5 THEN 'WARN' ELSE 'FAIL' END, CASE WHEN good > 0.8 THEN 'PASS' WHEN good > 0.5 THEN 'WARN' ELSE 'FAIL' END, CASE WHEN r > 0.9 THEN 'PASS' ELSE 'WARN' END, CASE WHEN n = det THEN 'PASS' ELSE 'WARN' END]) AS status FROM (SELECT (SELECT count(*) FROM fx_src) AS det, (SELECT count(*) FROM fx_ref) AS listed, count(*) AS n, avg((match_distance < 5)::INT) AS good, corr(s.feret_max_um, r.feret_max_um) AS r FROM near JOIN fx_src s ON s.row_idx = src_idx JOIN fx_ref r ON r.row_idx = ref_idx)", *BASE, CAND, NEAR)
def ext_6m(spark, d):
    side = lambda df, key, name: df.select(F.col("row_idx").alias(key), F.col("feret_max_um").alias(name))
    m = C.nearest(spark, d).join(side(X.src(spark, d), "src_idx", "size_detected"), "src_idx").join(side(X.ref(spark, d), "ref_idx", "size"), "ref_idx")
    return K.match_checks(m, X.src(spark, d).count(), X.ref(spark, d).count()).select("check", "status")


@query("ext_8_tile_counts", "SELECT row // 50 AS tile_row, col // 16 AS tile_col, count(*) AS n FROM fx_pixels WHERE value > 60 GROUP BY 1, 2", X.PIXELS)
def ext_8(spark, d):
    return X.pixels(spark, d).filter("value > 60").groupBy(F.floor(F.col("row") / 50).alias("tile_row"), F.floor(F.col("col") / 16).alias("tile_col")).agg(F.count("*").alias("n"))


@query("ext_10_markers", "SELECT row_idx, CASE WHEN area_um2 > 200 THEN 'large' WHEN area_um2 > 50 THEN 'medium' ELSE 'small' END AS marker FROM fx_src", X.SRC)
def ext_10(spark, d):
    return X.src(spark, d).select("row_idx", K.marker_class(F.col("area_um2")).alias("marker"))


@query("agg_3_rate", "SELECT round(avg(agree_exact::INT), 6) AS agreement_rate FROM graded", X.EVENTS, GRADED_EVENTS)
def agg_3(spark, d):
    return rounded(C.graded(spark, d).agg(F.avg(F.col("agree_exact").cast("double")).alias("agreement_rate")))


@query("agg_10_radius", "SELECT round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(sqrt(avg((x_um - cx) ** 2 + (y_um - cy) ** 2)), 6) AS radius FROM (SELECT *, avg(x_um) OVER () AS cx, avg(y_um) OVER () AS cy FROM fx_src)", X.SRC)
def agg_10(spark, d):
    return rounded(N.radius(X.src(spark, d)))


@query("agg_20_landmark_residuals", "SELECT count(*) AS n, round(avg(match_distance), 6) AS mean_residual FROM near WHERE match_distance <= 50", *BASE, CAND, NEAR)
def agg_20(spark, d):
    return rounded(fit.residual_stats(C.nearest(spark, d), 50))


@query("agg_21_join_quality", f"SELECT count(*) FILTER (c <= 2) AS joined, count(*) FILTER (c > 2) AS rejected, round(median(c), 6) AS median_cost, round(max(c), 6) AS max_cost FROM (SELECT min({C.SIZE_COST}) AS c FROM fx_third s, fx_ref r GROUP BY s.row_idx)", X.REF, X.THIRD)
def agg_21(spark, d):
    least = matching.size_edges(X.third(spark, d), X.ref(spark, d)).groupBy("src_idx").agg(F.min("cost").alias("c"))
    return rounded(least.agg(F.count_if(F.col("c") <= 2).alias("joined"), F.count_if(F.col("c") > 2).alias("rejected"), F.median("c").alias("median_cost"), F.max("c").alias("max_cost")))


@query("win_2_next_best", "SELECT src_idx, round(b, 6) AS next_best_distance FROM amb", *BASE, CAND, NEAR, ALLD, AMB)
def win_2(spark, d):
    return rounded(matching.ambiguity(C.nearest(spark, d), C.aligned(spark, d), X.ref(spark, d)).select("src_idx", "next_best_distance"))


@query("win_7_match_ids", "SELECT src_idx, row_number() OVER (ORDER BY src_idx) AS match_id FROM near", *BASE, CAND, NEAR)
def win_7(spark, d):
    from quern.operators.workflow import match_ids

    return match_ids(C.nearest(spark, d).select("src_idx")).select("src_idx", F.col("match_id").cast("long").alias("match_id"))


@query("top_5_largest", "SELECT k AS size_rank, row_idx FROM tb WHERE k <= 25", X.REF, X.SRC, TOPN)
def top_5(spark, d):
    return K.largest(X.ref(spark, d), 25).select("size_rank", "row_idx")


@query("top_8_materials", "SELECT DISTINCT material FROM fx_ref WHERE material IS NOT NULL ORDER BY material", X.REF)
def top_8(spark, d):
    return X.ref(spark, d).select("material").filter("material is not null").distinct().orderBy("material")


@query("set_2_layers", "SELECT 'ref' AS layer, row_idx, round(x_norm, 6) AS x, round(y_norm, 6) AS y FROM fx_ref UNION ALL SELECT 'src', row_idx, round(x_aligned, 6), round(y_aligned, 6) FROM src_al", *BASE)
def set_2(spark, d):
    a = X.ref(spark, d).select("row_idx", F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    return rounded(viewer.layers(ref=a, src=C.aligned(spark, d).select("row_idx", F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))))


@query("str_4_category", f"SELECT row_idx, {M.category_sql(M.family_sql('material'))} AS category FROM fx_ref", X.REF)
def str_4(spark, d):
    return X.ref(spark, d).select("row_idx", M.category(M.family(F.col("material"))).alias("category"))


@query("str_7_paired_names", "SELECT match_id, material_a_norm, material_b_norm FROM graded", X.EVENTS, GRADED_EVENTS)
def str_7(spark, d):
    return C.graded(spark, d).select("match_id", "material_a_norm", "material_b_norm")


@query("img_1_gray_mean", "SELECT row, col, round((value + value / 2 + value / 4) / 3, 6) AS gray FROM fx_pixels", X.PIXELS)
def img_1(spark, d):
    v = F.col("value")
    return rounded(X.pixels(spark, d).select("row", "col", imaging.gray_mean(v, v / 2, v / 4).alias("gray")))


@query("img_7_detect")
def img_7(spark, d):
    return rounded(imaging.detected(X.pixels(spark, d), 64, 40.0, 3))


@query("img_10_extract")
def img_10(spark, d):
    """Adaptive segmentation: local mean, foreground, components, properties, minimum size."""
    px = imaging.box_mean(X.pixels(spark, d), 5)
    fg = px.filter(F.abs(F.col("value") - F.col("local")) > 25)
    return rounded(imaging.properties(imaging.components(fg, 64).join(fg, ["row", "col"])).filter("area_px >= 4"))


@query("img_13_rotate", "SELECT 63 - col AS row, row AS col, round(value, 6) AS value FROM fx_pixels", X.PIXELS)
def img_13(spark, d):
    """A quarter turn of the whole image."""
    return rounded(imaging.quarter_turned(X.pixels(spark, d), 64))


@query("dia_2_overlay", "SELECT src_idx, round(x_aligned, 6) AS x, round(y_aligned, 6) AS y, round(x, 6) AS xend, round(y, 6) AS yend FROM resid", *BASE, CAND, NEAR, RESID)
def dia_2(spark, d):
    s = C.aligned(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))
    r = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("xend"), F.col("y_norm").alias("yend"))
    return rounded(C.nearest(spark, d).join(s, "src_idx").join(r, "ref_idx").select("src_idx", "x", "y", "xend", "yend"))


@query("dia_8_size_pairs", "SELECT n.src_idx, round(s.feret_max_um, 6) AS src_feret, round(r.feret_max_um, 6) AS ref_feret FROM near n JOIN fx_src s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx WHERE s.feret_max_um IS NOT NULL AND r.feret_max_um IS NOT NULL", *BASE, CAND, NEAR)
def dia_8(spark, d):
    a = X.src(spark, d).select(F.col("row_idx").alias("src_idx"), F.col("feret_max_um").alias("src_feret"))
    b = X.ref(spark, d).select(F.col("row_idx").alias("ref_idx"), F.col("feret_max_um").alias("ref_feret"))
    return rounded(C.nearest(spark, d).join(a, "src_idx").join(b, "ref_idx").dropna(subset=["src_feret", "ref_feret"]).select("src_idx", "src_feret", "ref_feret"))


@query("dia_10_tiers", "SELECT * FROM (UNPIVOT (SELECT material_a_norm AS material_a, count(*) FILTER (tier = 'Exact') AS \"Exact\", count(*) FILTER (tier = 'Family') AS \"Family\", count(*) FILTER (tier = 'Disagree') AS \"Disagree\" FROM graded GROUP BY 1) ON \"Exact\", \"Family\", \"Disagree\" INTO NAME tier VALUE n)", X.PAIRS, GRADED_PAIRS)
def dia_10(spark, d):
    return A.tiers_long(A.detail(C.graded(spark, d, X.pairs)), "material_a")


@query("agg_11_distortion", "SELECT n, round(dx, 6) AS dx_range, round(dy, 6) AS dy_range, CASE WHEN n < 20 THEN 'Too few' WHEN greatest(dx, dy) > 20 THEN 'Recommended' WHEN greatest(dx, dy) > 10 THEN 'Distortion' ELSE 'None' END AS assessment FROM (SELECT sum(n)::BIGINT AS n, max(dx) - min(dx) AS dx, max(dy) - min(dy) AS dy FROM (SELECT count(*) AS n, avg(x - x_aligned) AS dx, avg(y - y_aligned) AS dy FROM (SELECT *, median(x) OVER () AS mx, median(y) OVER () AS my FROM resid) GROUP BY x > mx, y > my))", *BASE, CAND, NEAR, RESID)
def agg_11(spark, d):
    return rounded(D.distortion(C._residuals(spark, d)))


@query("agg_9_size_by_material", "SELECT material, round(median(feret_max_um), 6) AS median_feret, count(*) AS n FROM fx_ref GROUP BY material", X.REF)
def agg_9m(spark, d):
    return rounded(X.ref(spark, d).groupBy("material").agg(F.median("feret_max_um").alias("median_feret"), F.count("*").alias("n")))


