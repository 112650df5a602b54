"""Orders, grids and the whole workflow against brute force and a planted transform."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions.geometry import Transform
from quern.operators import diagnostics, fit, imaging, matching, order, viewer, workflow
from quern.sources import sinks

PARTICLE = "row_idx long, particle_id string, x_um double, y_um double, area_um2 double, major_um double, minor_um double, feret_min_um double, feret_max_um double, material string, quality double"


def test_orders(spark, monkeypatch):
    monkeypatch.setattr(order, "PART", 40)
    monkeypatch.setattr(order, "FEW", 7)
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, rng.random() * 100])) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "i long, v double")
    known = sorted(v for _, v in rows if v is not None)
    for k in (1, 2, 150, 299, 300):
        assert order.kth_smallest(df, "v", k) == known[k - 1]
    assert order.kth_smallest(df, "v", 301) is None and order.kth_smallest(df.limit(0), "v", 1) is None
    got = order.numbered(df, "n", "v", "i").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.i: r.n for r in got} == {r[0]: k for k, r in enumerate(want, 1)}


@pytest.mark.parametrize("block", [50_000, 20])
def test_kendall(spark, monkeypatch, block):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.choice([rng.random(), 0.5])) for _ in range(150)]
    monkeypatch.setattr(diagnostics, "discordant", lambda df, p, q: order.discordant(df, p, q, block))
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    tp, tq = sum(a[0] == b[0] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs)
    row = diagnostics.kendall(spark.createDataFrame(rows, "p long, q double")).first()
    assert row.n == 150 and row.tau == pytest.approx(s / ((len(pairs) - tp) * (len(pairs) - tq)) ** 0.5)


def test_grid():
    rng = np.random.default_rng(1)
    points, asked = rng.normal(size=(300, 2)) * 10, rng.normal(size=(400, 2)) * 14
    for cell in (0.5, 3.0, 100.0):
        d = np.hypot(*(asked[:, None] - points[None]).transpose(2, 0, 1))
        got, at = fit.Grid(points, cell).nearest(asked)
        near = d.min(1) <= cell
        assert (np.isfinite(got) == near).all() and np.allclose(got[near], d.min(1)[near]) and (at[near] == d.argmin(1)[near]).all()


def planted(spark, n=120, seed=5):
    rng = random.Random(seed)
    t = Transform.rotation(170.0, False, 300.0, -200.0)
    names = ["Polypropylene", "Polyethylene terephtalate"]
    ref, src = [], []
    for i in range(n):
        x, y, size = rng.random() * 9000, rng.random() * 9000, 25 + rng.random() * 300
        ref.append((i, f"R_{i}", x, y, size * size, size, size / 2, size / 2, size, names[i % 2], 90.0))
        px, py = x - t.tx, y - t.ty
        sx, sy = t.a * px + t.b * py, -t.b * px + t.a * py
        if i % 4:
            src.append((i, f"P_{i}", sx + rng.gauss(0, 5), sy + rng.gauss(0, 5), size * size, size, size / 2, size / 2, size, ["Polypro", "PET"][i % 2], 0.9))
    return spark.createDataFrame(src, PARTICLE), spark.createDataFrame(ref, PARTICLE)


def test_workflow_and_its_files(spark, tmp_path):
    src, ref = planted(spark)
    config = Config(coarse_step_deg=5.0, ransac_iterations=100)
    found = workflow.run(src, ref, src.withColumn("material", F.lit("Polypropylene")), config)
    pairs = found.match.matched.select("src_idx", "ref_idx").collect()
    assert len(pairs) >= 85 and sum(r.src_idx == r.ref_idx for r in pairs) >= 0.98 * len(pairs)
    assert abs(found.alignment.transform.scale - 1) < 0.01 and found.alignment.history and found.third_verdict == "GOOD"
    assert found.triplets.filter("ftir_particle_id = ldir_particle_id").count() >= 80
    done = sinks.export_outcome(tmp_path, found, src, with_places=src.withColumn("coord_match_cost", F.lit(0.1)), extracted=src)
    assert {"matched_particles", "agreement_pairwise", "triage", "ldir_raman_matched", "triplets_3way", "ldir_coord_quality", "plot_icp_convergence", "plot_ldir_overlay", "tps_quadrant_residuals"} <= set(done)
    assert "icp_final_rms" in (tmp_path / "ldir_transform_params.txt").read_text() and "recommend_tps" in (tmp_path / "tps_assessment.txt").read_text()
    again = viewer.load_uploaded(spark, str(tmp_path / "matched_particles.csv"), str(tmp_path / "unmatched_raman.csv"), None, str(tmp_path / "transform_params.txt"))
    assert viewer.status(again)["matched"] == len(pairs) and "transform" in again
    with pytest.raises(ValueError):
        viewer.load_uploaded(spark, str(tmp_path / "nothing.csv"))


def test_third_alignment_fails_softly(spark):
    src, ref = planted(spark, 40)
    found = workflow.run(src, ref, src.withColumn("x_um", F.lit(None).cast("double")), Config(coarse_step_deg=5.0, ransac_iterations=50))
    assert found.third is None and found.third_match is None and found.match.matched.count() > 20


def test_ambiguity_by_rings(spark):
    rng = random.Random(9)
    ref = [(i, rng.random() * 50, rng.random() * 50) for i in range(40)] + [(40, 1e6, 1e6), (41, None, None)]
    src = [(i, rng.random() * 60, rng.random() * 60) for i in range(30)] + [(30, 1e6, 1e6), (31, None, None)]
    s = spark.createDataFrame(src, "row_idx long, x_aligned double, y_aligned double")
    r = spark.createDataFrame(ref, "row_idx long, x_norm double, y_norm double")
    own = {i: 40 if i == 30 else i % 40 for i, _, _ in src}
    m = spark.createDataFrame([(i, own[i], 1.0) for i in own], "src_idx long, ref_idx long, match_distance double")
    got = {x.src_idx: x for x in matching.ambiguity(m, s, r, 5.0).collect()}
    for i, x, y in src:
        d = {j: np.hypot(x - a, y - b) for j, a, b in ref if a is not None} if x is not None else {}
        near = sorted(v for j, v in d.items() if j != own[i])
        assert got[i].n_ref_candidates == sum(v <= 5 for v in d.values())
        assert got[i].next_best_distance == (pytest.approx(near[0]) if near else None)


def test_third_image(spark):
    """Three squares of saturated colour on gray, by the mode that the image asks for."""
    rows = []
    for r in range(60):
        for c in range(80):
            on = any(a <= r < a + 6 and b <= c < b + 7 for a, b in ((5, 5), (20, 40), (50, 70)))
            rows.append((r, c, 0.9 if on else 0.3, 0.7 if on else 0.3, 0.1 if on else 0.3))
    px = spark.createDataFrame(rows, "row long, col long, r double, g double, b double")
    found = imaging.extracted_by_saturation(px, 60, 80, (0.0, 8000.0, 0.0, 6000.0)).collect()
    assert [r.particle_id for r in sorted(found, key=lambda r: r.row_idx)] == ["LDIR_IMG_1", "LDIR_IMG_2", "LDIR_IMG_3"]
    assert sorted((round(r.x_um), round(r.y_um), r.area_px) for r in found) == [(850, 5200, 42), (4350, 3700, 42), (7350, 700, 42)]
    assert imaging.mode_of(px) == "adaptive" and 1 <= imaging.third_image(px, 60, 80).count() <= 3
