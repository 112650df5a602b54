import itertools
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions.geometry import Transform, aligned
from quern.operators import agreement, filters, fit, imaging, matching
from quern.sources import image, particles, runs, sinks


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = int(rng.integers(1, 6)), int(rng.integers(5, 7))
        cost = rng.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        column = matching.assignment(cost)
        assert len(set(column)) == n and np.isclose(cost[np.arange(n), column].sum(), best)


def edges(spark, seed, n=25):
    rng = np.random.default_rng(seed)
    rows = {(int(rng.integers(n)), int(rng.integers(n))): float(rng.random()) for _ in range(70)}
    return rows, spark.createDataFrame([(a, b, c, c, c) for (a, b), c in rows.items()], "src_idx long, ref_idx long, d double, cost double, score double")


def test_matchings(spark):
    rows, df = edges(spark, 3)
    best, taken = matching.optimal(df).collect(), matching.greedy(df).collect()
    used_s, used_r, want = set(), set(), set()
    for (a, b), _ in sorted(rows.items(), key=lambda x: (x[1], x[0])):
        if a not in used_s and b not in used_r:
            want.add((a, b))
            used_s.add(a)
            used_r.add(b)
    assert {(r.src_idx, r.ref_idx) for r in taken} == want
    for pairs in (best, taken):
        assert len({r.src_idx for r in pairs}) == len({r.ref_idx for r in pairs}) == len(pairs)
    assert len(best) >= len(taken)
    assert len(best) > len(taken) or sum(r.cost for r in best) <= sum(r.score for r in taken) + 1e-9
    empty = df.limit(0)
    assert matching.greedy(empty).count() == matching.optimal(empty).count() == 0


def cloud(spark, n=120, jitter=2.0, seed=5):
    rng = np.random.default_rng(seed)
    p, t = rng.uniform(-5000, 5000, (n, 2)), Transform.rotation(37.0, False, 250.0, -90.0)
    m = np.array(t.matrix)
    q = p @ m[:2, :2].T + m[:2, 2] + rng.normal(0, jitter, (n, 2))
    src = spark.createDataFrame([(i, *map(float, x), 50.0, 20.0) for i, x in enumerate(p)], "src_idx long, x_norm double, y_norm double, major_um double, minor_um double")
    ref = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "ref_idx long, x double, y double")
    return src, ref, t


def test_alignment_recovers_the_transform(spark):
    src, ref, t = cloud(spark)
    config = Config(coarse_step_deg=3.0, ransac_iterations=200)
    start, n = fit.ransac(src, ref, config)
    assert n == 120 and abs(start.rotation_deg - 37) < 1
    end, history, done = fit.icp(src, ref, start, config)
    assert done and history[-1] < 5 and abs(end.rotation_deg - 37) < 0.1 and abs(end.scale - 1) < 0.002
    found = fit.landmark(src, ref, config)
    assert found and found[1]


def test_reflected_fit(spark):
    t = Transform(0.6, 0.8, 5.0, -3.0, True)
    pts = np.random.default_rng(0).normal(size=(20, 2))
    m = np.array(t.matrix)
    q = pts @ m[:2, :2].T + m[:2, 2]
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(pts, q)], "px double, py double, qx double, qy double")
    got = fit.estimate(df, True)
    assert got.reflected and np.allclose([got.a, got.b, got.tx, got.ty], [0.6, 0.8, 5, -3])
    full = t.after(Transform.rotation(20, False, 1, 2))
    assert np.allclose(full.matrix, np.array(t.matrix) @ np.array(Transform.rotation(20, False, 1, 2).matrix))


def pixels(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], "row long, col long, value double")


@pytest.mark.parametrize("shape, n", [("empty", 0), ("blob", 1), ("gradient", 0), ("seam", 1)])
def test_detection(spark, shape, n):
    size = 100
    y, x = np.mgrid[:size, :size]
    a = {"empty": np.zeros((size, size)), "blob": 100 * np.exp(-((x - 25) ** 2 + (y - 25) ** 2) / (2 * 2.5**2)), "gradient": x * 0.5, "seam": 100 * np.exp(-((x - 25) ** 2 + (y - 50) ** 2) / (2 * 2.5**2))}[shape]
    flat = imaging.corrected(pixels(spark, a), size, size, 2, 2, 60.0)
    assert flat.count() == size * size
    assert imaging.detected(flat, size, 15, 10).count() == n


def test_components_are_flood_fill(spark):
    a = (np.random.default_rng(2).random((30, 40)) < 0.55).astype(float)
    got = {(r.row, r.col): r.label for r in imaging.components(pixels(spark, a).filter("value > 0"), 40).collect()}
    seen = {}
    for start in zip(*np.nonzero(a)):
        stack = [start] if start not in seen else []
        while stack:
            p = stack.pop()
            if p in seen or not (0 <= p[0] < 30 and 0 <= p[1] < 40) or not a[p]:
                continue
            seen[p] = start[0] * 40 + start[1]
            stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert got == {(int(i), int(j)): int(v) for (i, j), v in seen.items()}


def test_sources(spark, tmp_path):
    (tmp_path / "a FTIR.csv").write_bytes("Identifier,Coord. [pixel],Coord. [um],Group,Area on map [um²],Major dim [um],Minor dim [um],Max AAU score\nMP_-1,[1;1],[10.5;-2], PET ,7,3,2,0.9\nMP_-1,[2;2],[x],,n/a,,,\n".encode("latin-1"))
    rows = particles.ingest_ftir(spark, str(tmp_path / "a FTIR.csv")).orderBy("row_idx").collect()
    assert [(r.row_idx, r.x_um, r.y_um, r.material, r.area_um2, r.feret_max_um, r.quality) for r in rows] == [(0, 10.5, -2.0, "PET", 7.0, 3.0, 0.9), (1, None, None, None, None, None, None)]
    (tmp_path / "r.csv").write_bytes("Particle Name;Visual Center Point X [µm];Visual Center Point Y [µm];Material;HQI\nR1;1.5;2;PP;80\n".encode("latin-1"))
    assert particles.ingest_raman(spark, str(tmp_path / "r.csv")).first().x_um == 1.5
    with pytest.raises(ValueError):
        particles.read_table(spark, "x.txt")
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "l.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Particles" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Id</t></si><si><t>Width</t></si><si><t>Height</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" t="inlineStr"><is><t>p</t></is></c><c r="C2"><v>4</v></c></row></sheetData></worksheet>')
    r = particles.ingest_ldir(spark, str(tmp_path / "l.xlsx")).first()
    assert (r.particle_id, r.feret_max_um, r.feret_min_um, r.x_um) == ("p", 4.0, 4.0, None)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([255, 0, 0, 0, 0, 51]))) + chunk(b"IEND", b"")
    (tmp_path / "i.png").write_bytes(png)
    assert [(p.row, p.col, p.r, p.g, p.b) for p in image.read_pixels(spark, str(tmp_path / "i.png")).orderBy("col").collect()] == [(0, 0, 1.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.2)]


def test_runs(spark, tmp_path):
    one = runs.make_run_dir(str(tmp_path))
    df = spark.createDataFrame([(1, 2.5, None)], "match_id long, d double, m string")
    assert sinks.export(one, {"matched_particles": df, "triplets_3way": df.limit(0)}, Transform(0.5, 0, 1, 2), 3.0) == ["matched_particles"]
    two = runs.make_run_dir(str(tmp_path))
    assert two.name.endswith("_2") and runs.find_latest_run(str(tmp_path)) == one
    back = runs.load_run(spark, one)
    assert list(back) == ["matched_particles"] and back["matched_particles"].first().d == 2.5
    assert runs.transform_parameters(spark, str(one / "transform_params.txt"))["Scale"] == 0.5


def test_nulls(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, None, 5.0, "PET"), (1, 1.0, None, 80.0, 5.0, None), (2, 1.0, 1.0, 50.0, None, " ")], "row_idx long, x_um double, y_um double, quality double, feret_max_um double, material string")
    ids = lambda d: sorted(r.row_idx for r in d.collect())
    assert ids(filters.prefilter_ftir(df, 60)) == [0] and ids(filters.prefilter_raman(df, 60)) == [] and ids(filters.prefilter_ldir(df, 60, 1)) == [0, 1]
    none = df.withColumn("quality", F.lit(None).cast("double"))
    assert ids(filters.prefilter_raman(none, 60)) == [0, 2]
    pairs = agreement.paired(spark.createDataFrame([(None, "PET"), ("PET ", "pet"), ("PA", "Nylon 6")], "material_a string, material_b string"))
    assert sorted(r.tier for r in pairs.collect()) == ["Disagree", "Exact", "Family"]


def test_match(spark):
    rows = [(i, f"p{i}", float(i * 400), 0.0, 10.0, 5.0, 2.0, 5.0, "PET") for i in range(5)]
    schema = "row_idx long, particle_id string, x_norm double, y_norm double, area_um2 double, major_um double, minor_um double, feret_max_um double, material string"
    src, ref = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[1:], schema)
    for method in ("optimal", "greedy"):
        got = matching.match(aligned(src, Transform()), ref, Config(match_method=method))
        assert sorted((r.src_idx, r.ref_idx) for r in got.matched.collect()) == [(i, i) for i in range(1, 5)]
        assert [r.row_idx for r in got.unmatched_src.collect()] == [0] and got.unmatched_ref.count() == 0
        assert got.stats.first().n_matched == 4
