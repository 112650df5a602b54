"""Queries of whole workflows and of what a viewer places, and invariants of operators that SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import geometry as G
from quern.operators import diagnostics as D
from quern.operators import filters as L
from quern.operators import fit, imaging, matching, viewer, workflow
from quern.plans import catalog as C
from quern.plans import fixtures as X
from quern.plans.catalog import ALLD, AMB, BASE, CAND, NEAR, query, rounded


@query("agg_17_image_bounds", "SELECT round((x0 + x1) / 2 - w / 2, 6) AS x_min, round((x0 + x1) / 2 + w / 2, 6) AS x_max, round((y0 + y1) / 2 - h / 2, 6) AS y_min, round((y0 + y1) / 2 + h / 2, 6) AS y_max FROM (SELECT *, CASE WHEN sx / sy > 1.5 THEN sx ELSE sy * 1.5 END AS w, CASE WHEN sx / sy > 1.5 THEN sx / 1.5 ELSE sy END AS h FROM (SELECT min(x_um) AS x0, max(x_um) AS x1, min(y_um) AS y0, max(y_um) AS y1, max(x_um) - min(x_um) + 600 AS sx, max(y_um) - min(y_um) + 600 AS sy FROM fx_src))", X.SRC)
def agg_17(spark, d):
    return rounded(viewer.image_bounds(X.src(spark, d), 1000, 1500, "x_um", "y_um"))


@query("prj_18_scan_bounds", "SELECT round((x0 + x1) / 2 - w / 2, 6) AS x_min, round((x0 + x1) / 2 + w / 2, 6) AS x_max, round((y0 + y1) / 2 - h / 2, 6) AS y_min, round((y0 + y1) / 2 + h / 2, 6) AS y_max FROM (SELECT *, CASE WHEN x1 > 2500 THEN ceil(x1 / 500) * 500 ELSE 2500 END AS w, CASE WHEN y1 > 12500 THEN ceil(y1 / 500) * 500 ELSE 12500 END AS h FROM (SELECT min(x_um) AS x0, max(x_um) AS x1, min(y_um) AS y0, max(y_um) AS y1 FROM fx_src))", X.SRC)
def prj_18(spark, d):
    return rounded(viewer.scan_bounds(X.src(spark, d), 2999, 599))


@query("prj_15_saturation_um", "SELECT row, col, round(100 + (col + 0.5) * (1000.0::DOUBLE / 64), 6) AS x_um, round(100 + 1000 - (row + 0.5) * (1000.0::DOUBLE / 500), 6) AS y_um FROM fx_pixels", X.PIXELS)
def prj_15(spark, d):
    p = X.pixels(spark, d)
    return rounded(p.select("row", "col", G.pixel_to_um(F.col("col") + 1, 100.0, 1000.0, 64).alias("x_um"), G.pixel_to_um(F.col("row") + 1, 100.0, 1000.0, 500, flip=True).alias("y_um")))


@query("vw_2_layers", "SELECT layer, row_idx, round(x, 6) AS x, round(xend, 6) AS xend FROM (SELECT CASE WHEN row_idx IN (SELECT src_idx FROM near) THEN 'ftir_matched' ELSE 'ftir_unmatched' END AS layer, row_idx, x_aligned AS x, NULL::DOUBLE AS xend FROM src_al UNION ALL SELECT CASE WHEN row_idx IN (SELECT ref_idx FROM near) THEN 'raman_matched' ELSE 'raman_unmatched' END, row_idx, x_norm, NULL FROM fx_ref UNION ALL SELECT CASE WHEN row_idx IN (SELECT third_idx FROM near3) THEN 'ldir_matched' ELSE 'ldir_unmatched' END, row_idx, x_aligned, NULL FROM third_al UNION ALL SELECT 'links', n.src_idx, s.x_aligned, r.x_norm FROM near n JOIN src_al s ON s.row_idx = n.src_idx JOIN fx_ref r ON r.row_idx = n.ref_idx UNION ALL SELECT 'triples', row_idx, x_norm, NULL FROM fx_ref WHERE row_idx IN (SELECT ref_idx FROM near) AND row_idx IN (SELECT ref_idx FROM near3))", *BASE, CAND, NEAR, X.THIRD, C.THIRD_AL, C.NEAR3)
def vw_2(spark, d):
    third = G.aligned(X.third(spark, d), C.T3)
    near3 = matching.candidates(third, X.ref(spark, d)).filter("rank = 1").select("src_idx", "ref_idx")
    out = viewer.overlay_layers(C.aligned(spark, d), X.ref(spark, d), C.nearest(spark, d), third, near3)
    return rounded(out.select("layer", "row_idx", "x", "xend"))


@query("vw_3_third_extent", "SELECT 0.0::DOUBLE AS x_min, ceil(max(x_um) / 1000) * 1000 AS x_max, 0.0::DOUBLE AS y_min, ceil(max(y_um) / 1000) * 1000 AS y_max FROM fx_third", X.THIRD)
def vw_3(spark, d):
    return viewer.third_extent(X.third(spark, d))


@query("dia_9_ambiguity", "SELECT least(floor((s - lo) / w), 29)::BIGINT AS bin, count(*) AS n, count(*) FILTER (s > 0.7 OR c >= 3) AS flagged FROM (SELECT *, min(s) OVER () AS lo, (max(s) OVER () - min(s) OVER ()) / 30 AS w FROM (SELECT c, CASE WHEN b > 0 THEN match_distance / b ELSE 0 END AS s FROM amb)) GROUP BY 1", *BASE, CAND, NEAR, ALLD, AMB)
def dia_9(spark, d):
    return D.ambiguity_histogram(matching.ambiguity(C.nearest(spark, d), C.aligned(spark, d), X.ref(spark, d)))


@query("dia_4_convergence", "SELECT true AS first_is_one, true AS falls")
def dia_4(spark, d):
    s, r = C._clouds(spark, d)
    _, history, _ = fit.icp(s, r, G.Transform(C.T.a, C.T.b, C.T.tx + 40, C.T.ty - 30))
    rows = D.convergence(history, spark)
    return rows.agg((F.min("iteration") == 1).alias("first_is_one"), (F.min_by("rms", F.col("iteration")) >= F.max_by("rms", F.col("iteration"))).alias("falls"))


@query("top_2_angles", "SELECT 5::BIGINT AS n, true AS best_first")
def top_2(spark, d):
    s, r = C._clouds(spark, d)
    top = fit.top_angles(fit.hypotheses(L.anchors(s, ("PET",)), L.anchors(r, ("tereph",)), Config(coarse_step_deg=4.0)))
    best = fit.coarse(L.anchors(s, ("PET",)), L.anchors(r, ("tereph",)), Config(coarse_step_deg=4.0))[1]
    return top.agg(F.count("*").alias("n"), (F.max("n") == best).alias("best_first"))


@query("img_15_view", "SELECT row, col, round(value / (SELECT max(value) FROM fx_pixels), 6) AS green FROM fx_pixels", X.PIXELS)
def img_15(spark, d):
    return rounded(imaging.processed_view(X.pixels(spark, d)))


@query("ext_2_tile_join", "SELECT true AS once, true AS same_tile, true AS cheap")
def ext_2(spark, d):
    """Every image object is given once, to a row of its own tile, at no more than the limit."""
    tile = lambda df: df.withColumn("tile", F.col("row_idx") % 7)
    a, b = tile(X.third(spark, d)), tile(X.src(spark, d))
    out = matching.size_join(a, b, by=("tile",)).filter("coord_source = 'image'")
    found = out.join(b.select(F.col("tile").alias("t"), F.col("row_idx").alias("coord_idx")), "coord_idx")
    return found.agg((F.count("*") == F.count_distinct("coord_idx")).alias("once"), F.every(F.col("tile") == F.col("t")).alias("same_tile"), (F.max("coord_match_cost") <= 2).alias("cheap"))


@query("ext_7_seams", "SELECT k AS tiles, round(avg(abs(m.mean - l.mean)), 6) AS strength FROM (SELECT row, avg(value) AS mean FROM fx_pixels GROUP BY 1) m JOIN (SELECT row + 1 AS row, avg(value) AS mean FROM fx_pixels GROUP BY 1) l USING (row) JOIN (SELECT k, i * (500 // k) AS row FROM (SELECT unnest(range(2, 9)) AS k) CROSS JOIN (SELECT unnest(range(1, 8)) AS i) WHERE i < k) g USING (row) GROUP BY 1", X.PIXELS)
def ext_7(spark, d):
    return rounded(imaging.seams(X.pixels(spark, d), 500))


@query("ext_9_gray", "SELECT row, col, round(value / 4, 6) AS blue, round(value * 100 / 257, 6) AS eight FROM fx_pixels", X.PIXELS)
def ext_9(spark, d):
    v = F.col("value")
    return rounded(X.pixels(spark, d).select("row", "col", imaging.blue_gray(v, v / 2, v / 4).alias("blue"), imaging.to_eight_bit(v * 100).alias("eight")))


@query("agg_12_component_sizes", "SELECT true AS whole, true AS boxed")
def agg_12(spark, d):
    """The components' pixels add up to the foreground, and each fits its box."""
    fg = C._foreground(spark, d)
    objects = imaging.r_properties(imaging.components(fg, 64).join(fg, ["row", "col"]))
    return objects.agg((F.sum("area_px") == fg.count()).alias("whole"), F.every(F.col("area_px") <= F.col("bbox_h") * F.col("bbox_w")).alias("boxed"))


def _colours(spark, d):
    v = F.col("value") / 640  # only bright pixels are foreground
    return X.pixels(spark, d).select("row", "col", v.alias("r"), (v / 2).alias("g"), (v / 4).alias("b"))


@query("img_9_full_pipeline", "SELECT true AS large_enough, true AS in_tile, 40.0::DOUBLE AS threshold")
def img_9(spark, d):
    objects, used = imaging.full_pipeline(X.pixels(spark, d), C._height(spark, d), 64, 4, 1, threshold=40.0, least=3)
    return objects.agg((F.min("area_px") >= 3).alias("large_enough"), F.every((F.col("local_y") >= 0) & F.col("tile_row").between(0, 3)).alias("in_tile"), F.lit(used).alias("threshold"))


@query("img_11_saturation", "SELECT true AS sized, true AS inside")
def img_11(spark, d):
    """Particles of saturated colour: at least 15 pixels and 20 micrometres, within the scan."""
    found = imaging.extracted_by_saturation(_colours(spark, d), C._height(spark, d), 64, (0.0, 13000.0, 0.0, 13000.0))
    return found.agg(F.coalesce(F.every((F.col("area_px") >= 15) & (F.col("feret_max_um") >= 20)), F.lit(True)).alias("sized"), F.coalesce(F.every(F.col("x_um").between(0, 13000) & F.col("y_um").between(0, 13000)), F.lit(True)).alias("inside"))


@query("flt_14_sized", "SELECT row_idx FROM fx_src WHERE area_um2 >= 5000 AND feret_max_um >= 90", X.SRC)
def flt_14(spark, d):
    return imaging.sized(X.src(spark, d).withColumn("area_px", F.col("area_um2")), 5000, 90).select("row_idx")


@query("asg_1_invariants", "SELECT true AS src_once, true AS ref_once, true AS as_many_as_greedy")
def asg_1i(spark, d):
    best = matching.optimal(C.cands(spark, d))
    fewer = matching.greedy(matching.candidates(C.aligned(spark, d), X.ref(spark, d))).count()
    return best.agg((F.count("*") == F.count_distinct("src_idx")).alias("src_once"), (F.count("*") == F.count_distinct("ref_idx")).alias("ref_once"), (F.count("*") >= fewer).alias("as_many_as_greedy"))


@query("asg_2_invariants", "SELECT true AS src_once, true AS ref_once, true AS maximal")
def asg_2i(spark, d):
    """One to one, and no candidate is left whose ends are both free."""
    edges = matching.candidates(C.aligned(spark, d), X.ref(spark, d), k=5)
    taken = matching.greedy(edges)
    free = edges.join(taken.select("src_idx"), "src_idx", "left_anti").join(taken.select("ref_idx"), "ref_idx", "left_anti").count()
    return taken.agg((F.count("*") == F.count_distinct("src_idx")).alias("src_once"), (F.count("*") == F.count_distinct("ref_idx")).alias("ref_once"), F.lit(free == 0).alias("maximal"))


@query("fit_6_invariants", "SELECT true AS scale, true AS turned, true AS converged")
def fit_6i(spark, d):
    """The refinement finds the planted transform from a displaced start."""
    s, r = C._clouds(spark, d)
    t, history, done = fit.icp(s, r, G.Transform(C.T.a, C.T.b, C.T.tx + 40, C.T.ty - 30))
    near = abs((t.rotation_deg - C.T.rotation_deg + 180) % 360 - 180) < 0.5
    return spark.createDataFrame([(abs(t.scale - C.T.scale) < 0.01, near, done)], "scale boolean, turned boolean, converged boolean")


@query("fit_7_workflow", "SELECT true AS one_to_one, true AS recovered, true AS graded")
def fit_7(spark, d):
    """Tables to agreement in one call: the planted transform is found, and most pairs are the planted ones."""
    found = workflow.run(X.src(spark, d), X.ref(spark, d), None, Config(hqi_threshold=0.0, coarse_step_deg=4.0, ransac_iterations=300))
    m = found.match.matched.select("src_idx", "ref_idx")
    got = m.agg(F.count("*").alias("n"), F.count_distinct("ref_idx").alias("r"), F.count_if(F.col("src_idx") == F.col("ref_idx")).alias("true_pairs"))
    tiers = found.graded.agg(F.every(F.col("tier").isin("Exact", "Family", "Disagree")).alias("graded"))
    return got.crossJoin(tiers).select((F.col("n") == F.col("r")).alias("one_to_one"), (F.col("true_pairs") >= 0.9 * F.col("n")).alias("recovered"), "graded")


@query("fit_8_third", "SELECT true AS recovered, true AS triplets_meet")
def fit_8(spark, d):
    """With the third instrument: its pairs are the planted ones, and triplets share the reference."""
    found = workflow.run(X.src(spark, d), X.ref(spark, d), X.third(spark, d), Config(hqi_threshold=0.0, ldir_quality=0.0, coarse_step_deg=4.0, ransac_iterations=300))
    m = found.third_match.matched.agg((F.count_if(F.col("src_idx") == F.col("ref_idx")) >= 0.8 * F.count("*")).alias("recovered"))
    both = found.triplets.agg(F.every((F.col("material_consensus") == "None") == (F.col("n_instrument_agreement") == 0)).alias("triplets_meet"))
    return m.crossJoin(both)
