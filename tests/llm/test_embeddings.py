import numpy as np
import pytest

from quern.llm import embeddings as e
from quern.llm.components import components


def brute(rows, t=0.98):
    ids = [r[0] for r in rows]
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                    n[a[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("cells", [1, 9])
def test_brute_force(spark, cells, monkeypatch):
    monkeypatch.setattr(e, "CELL_ROWS", 600 // cells)
    monkeypatch.setattr(e, "BLOCK", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(size=8) * [0.02, 0.1, 0.3][i % 3]).tolist(), int(i % 60 > 40) if i % 13 else 0) for i in range(500)]
    rows += [(600, None, 1), (601, [0.0] * 8, 1), (602, [float("nan")] + [1.0] * 7, 1), (603, [float("inf")] + [1.0] * 7, 0), (604, [None] + [1.0] * 7, 0), (605, rows[0][1], None), (606, [], 0), (607, [1.0], 0), (608, [2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    got = e.near_dedup(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_empty(spark):
    assert e.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (70, 100), (7, 7), (None, 3), (41, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(42), 0), 50: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_oracle(spark):
    from quern.llm.queries import ORACLES, QUERIES
    from tests.compare import connect, same

    sf_dir = "/root/testdata/sf0.001"
    own, other = same(QUERIES["op7_embedding_dedup"](spark, sf_dir), connect(sf_dir), ORACLES["op7_embedding_dedup"])
    assert own == other
