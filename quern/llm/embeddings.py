"""Operator 7: embedding near-dedup by spherical k-means cells and blocked cosine products.

Vectors are compared only with vectors of the same label. Unit vectors are assigned
to the nearest of K centroids (spherical k-means in numpy, fitted on at most SAMPLE
rows; every row is assigned). The search within cells is exact: if y lies in cell c
and cos(x, y) >= t, then |x - y| <= s = sqrt(2 - 2t), and as y is nearest to c,
x.d - x.c <= s * |d - c| for every centroid d; x is sent as a probe to exactly the cells
for which that holds. Each cell is cut into blocks of BLOCK rows, and a task multiplies one
block of probes with one block of members, so a hot cell is many tasks of bounded
size. A block gives link counts for its rows and, instead of all pairs, a spanning
set of links for each of its connected parts; distributed union-find joins them.

K follows the rows of the largest label, from 2 up to CELLS, so the centroids that every
task gets have a fixed bound; fewer than LEAST vectors are one cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are kept; vectors of
different lengths link with nothing; repeated vec_ids are rows of one vector id: each
row is compared, and the id's row count of links counts rows. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.components import components

THRESHOLD = 0.98
SAMPLE = 20_000
CELLS = 256
CELL_ROWS = 2048
LEAST = 16
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell is reseeded with the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        home = sims.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        for i in np.flatnonzero(norms < 1e-9):
            sums[i] = x[sims.max(1).argmin()]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a matrix of the cells that it must probe (home included)."""
    sims = x @ c.T
    home = sims.argmax(1)
    reach = np.sqrt(2 - 2 * threshold) * np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) + 1e-9
    probes = np.ones(sims.shape, bool)
    for d in range(len(c)):
        probes &= sims[:, [d]] - sims <= reach[d]
    return home, probes


def _valid(embedding: str, label: str):
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def link(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cells: int = CELLS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(counts, links): counts has row, n_links; links has a, b: vec_ids whose links span every linked group."""
    spark = vectors.sparkSession
    good = vectors.filter(_valid(embedding, label)).select(F.col(vec_id).cast("long").alias("id"), F.concat_ws("/", F.col(label).cast("string"), F.size(embedding).cast("string")).alias("part"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    most = good.groupBy("part").count().agg(F.max("count").alias("n")).first().n or 0
    sizes = [r[0] for r in good.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(64).collect()]
    k = 1 if most < LEAST else int(min(cells, max(2, -(-most // CELL_ROWS))))
    models: dict[int, np.ndarray] = {}
    for size in sizes if k > 1 else []:
        rows = good.filter(F.size("v") == size).orderBy(F.xxhash64("id")).limit(SAMPLE // len(sizes)).select("v").collect()
        models[size] = spherical_kmeans(_unit([r.v for r in rows]), k)
    shared = spark.sparkContext.broadcast(models)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, g in f.groupby(f.v.map(len)):
                x = _unit(g.v.tolist())
                c = shared.value.get(size)
                home, probes = cells_of(x, c, threshold) if c is not None else (np.zeros(len(x), int), np.ones((len(x), 1), bool))
                row, cell = np.nonzero(probes)
                own = cell == home[row]
                yield pd.DataFrame({"row": g["row"].to_numpy()[row], "id": g["id"].to_numpy()[row], "part": g["part"].to_numpy()[row], "cell": cell, "member": own, "v": [x[i].tobytes() for i in row]})

    numbered = written(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dealt = numbered.mapInPandas(assign, "row long, id long, part string, cell int, member boolean, v binary")
    # A row's block within its cell is drawn by its hash, from as many blocks as the cell's rows call for.
    dealt = written(dealt, "cells")
    count = dealt.groupBy("part", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n_probe"), F.greatest(F.lit(1), F.ceil(F.count_if("member") / block)).cast("int").alias("n_member"))
    dealt = dealt.join(count, ["part", "cell"])
    at = lambda m: F.pmod(F.xxhash64("row", "cell"), F.col(m)).cast("int")
    probes = dealt.select("part", "cell", at("n_probe").alias("p"), F.explode(F.sequence(F.lit(0), F.col("n_member") - 1)).alias("m"), F.lit(False).alias("is_member"), "row", "id", "v")
    members = dealt.filter("member").select("part", "cell", F.explode(F.sequence(F.lit(0), F.col("n_probe") - 1)).alias("p"), at("n_member").alias("m"), F.lit(True).alias("is_member"), "row", "id", "v")

    def product(f: pd.DataFrame) -> pd.DataFrame:
        y = f[f.is_member]
        x = f[~f.is_member]
        if not len(x) or not len(y):
            return pd.DataFrame({"row": [], "n": [], "a": [], "b": []})
        xs, ys = _stack(x.v), _stack(y.v)
        xr, yr, xi, yi = x["row"].to_numpy(), y["row"].to_numpy(), x["id"].to_numpy(), y["id"].to_numpy()
        hits = [np.zeros((0, 2), np.int64)]
        step = 256
        for i in range(0, len(xs), step):
            a, b = np.nonzero(xs[i : i + step] @ ys.T >= threshold)
            a += i
            ok = xr[a] != yr[b]
            hits.append(np.stack([a[ok], b[ok]], 1))
        hit = np.concatenate(hits)
        n = np.bincount(hit[:, 0], minlength=len(xs))
        out = pd.DataFrame({"row": xr[n > 0], "n": n[n > 0], "a": -1, "b": -1})
        a, b = _spanning(xi[hit[:, 0]], yi[hit[:, 1]])
        return pd.concat([out, pd.DataFrame({"row": -1, "n": 0, "a": a, "b": b})])

    found = probes.unionByName(members).groupBy("part", "cell", "p", "m").applyInPandas(product, "row long, n long, a long, b long")
    found = written(found, "products")
    counts = found.filter("row >= 0").groupBy("row").agg(F.sum("n").alias("n_links"))
    by_id = counts.join(numbered.select("row", "id"), "row").groupBy("id").agg(F.max("n_links").alias("n_links"))
    return by_id, found.filter("row < 0").select("a", "b")


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components would vanish or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links of one block, one for each time two parts meet: at most a link less than there are nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors; a group's smallest id is its representative."""
    counts, links = link(vectors, threshold, vec_id, embedding, label)
    groups = components(links, "a", "b")
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = out.join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
