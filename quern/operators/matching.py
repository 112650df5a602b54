"""One-to-one and one-to-many matching of two particle tables, and what follows from it."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions.geometry import adaptive_threshold, feature_cost, greedy_score, size_cost
from quern.operators import spatial
from quern.operators.graph import checkpointed, labelled

PARTICLE = ["area_um2", "major_um", "minor_um", "feret_max_um"]


@dataclass(frozen=True)
class MatchResult:
    matched: DataFrame
    stats: DataFrame
    unmatched_src: DataFrame
    unmatched_ref: DataFrame


def _side(df: DataFrame, key: str, x: str, y: str, prefix: str) -> DataFrame:
    return df.select(F.col("row_idx").alias(key), F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(f"{prefix}{c}") for c in PARTICLE])


def candidates(src: DataFrame, ref: DataFrame, config: Config = Config(), k: int = 20) -> DataFrame:
    """src_idx, ref_idx, d, cost of the k nearest references within each source's own threshold.

    The thresholds' maximum is one small aggregate; it is the cell width.
    """
    threshold = adaptive_threshold(F.col("major_um"), config.match_threshold_um, config.match_size_fraction)
    cell = src.agg(F.max(threshold)).first()[0] or config.match_threshold_um
    left = _side(src, "src_idx", "x_aligned", "y_aligned", "s_").withColumn("t", adaptive_threshold(F.col("s_major_um"), config.match_threshold_um, config.match_size_fraction))
    right = _side(ref, "ref_idx", "x_norm", "y_norm", "r_")
    pairs = spatial.ranked(spatial.within(left, right, F.col("t"), cell), k)
    record = lambda p: {"area": F.col(f"{p}area_um2"), "feret": F.col(f"{p}feret_max_um"), "major": F.col(f"{p}major_um"), "minor": F.col(f"{p}minor_um")}
    cost = feature_cost(F.col("d"), record("s_"), record("r_"), (config.area_weight, config.feret_weight, config.aspect_weight))
    score = greedy_score(F.col("d"), F.col("s_feret_max_um"), F.col("r_feret_max_um"), config.match_size_weight)
    return pairs.select("src_idx", "ref_idx", "d", "rank", cost.alias("cost"), score.alias("score"))


def greedy(edges: DataFrame, cost: str = "score") -> DataFrame:
    """Takes, again and again, every edge that is the cheapest of both its ends: as taking edges one by one in order."""
    order = F.struct(cost, "src_idx", "ref_idx")
    left, taken = checkpointed(edges.select("src_idx", "ref_idx", "d", cost)), None
    while left.limit(1).count():
        by_src = left.groupBy("src_idx").agg(F.min(order).alias("s"))
        by_ref = left.groupBy("ref_idx").agg(F.min(order).alias("r"))
        new = checkpointed(left.join(by_src, "src_idx").join(by_ref, "ref_idx").filter((F.col("s") == order) & (F.col("r") == order)).select(*left.columns))
        taken = new if taken is None else taken.unionByName(new)
        left = checkpointed(left.join(new.select("src_idx"), "src_idx", "left_anti").join(new.select("ref_idx"), "ref_idx", "left_anti"))
    return left if taken is None else taken


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            reduced = np.concatenate([[np.inf], cost[owner[column] - 1] - u[owner[column]] - v[1:]])
            better = ~done & (reduced < least)
            least[better], back[better] = reduced[better], column
            step_to = int(np.where(done, np.inf, least).argmin())
            step = least[step_to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            column = step_to
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    out = np.full(n, -1)
    for column in range(1, m + 1):
        if owner[column]:
            out[owner[column] - 1] = column - 1
    return out


def sparse_assignment(start: np.ndarray, column: np.ndarray, cost: np.ndarray, m: int, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row or -1, u, v): least total cost of the edges, a row without a column costs far.

    The edges of row i are start[i]:start[i + 1] of column and cost; m is the number of columns. u and v are the prices
    of rows and columns: no edge is cheaper than its ends' prices, those that are taken cost just that. Shortest
    augmenting paths over the edges alone, so memory follows their number.
    """
    n, ends, costs = len(start) - 1, column.tolist(), cost.tolist()
    begin = start.tolist()
    of_row, of_column = [-1] * n, [-1] * m
    price, value = [far] * n, [0.0] * m
    # Free rows bid for their cheapest column what the next cheapest leaves; most rows are settled so.
    free = list(range(n))
    for _ in range(3):
        bidders, free = free, []
        while bidders:
            i = bidders.pop()
            first = second = far
            at = -1
            for e in range(begin[i], begin[i + 1]):
                c = costs[e] - value[ends[e]]
                if c < first or (c == first and c < far and of_column[ends[e]] < 0 <= of_column[at]):
                    first, second, at = c, first, ends[e]
                elif c < second:
                    second = c
            price[i] = min(second, far)
            if at < 0:
                continue
            last = of_column[at]
            if last >= 0 and first >= second:
                free.append(i)
                price[i] = first
                continue
            # A column without an owner keeps its price of 0, as paths may end at it.
            if last >= 0:
                value[at] -= second - first
                of_row[last] = -1
                free.append(last)
            else:
                price[i] = first
            of_row[i], of_column[at] = at, i
    for row in free:
        if of_row[row] < 0:
            _augment(row, begin, ends, costs, far, price, value, of_row, of_column)
    return np.array(of_row, np.int64), np.array(price), np.array(value)


def _augment(row: int, begin: list[int], ends: list[int], costs: list[float], far: float, price: list[float], value: list[float], of_row: list[int], of_column: list[int]) -> None:
    """Gives one more row its column, or leaves that row without one whose loss costs least."""
    dist, back, done = {}, {}, {}
    rows, heap = [(row, 0.0)], []
    give_up, loser, goal = far - price[row], row, -1
    i, here = row, 0.0
    while True:
        over = here - price[i]
        for e in range(begin[i], begin[i + 1]):
            j = ends[e]
            if j in done:
                continue
            d = over + costs[e] - value[j]
            if d < here:  # rounding
                d = here
            if d < give_up and d < dist.get(j, math.inf):
                dist[j], back[j] = d, i
                heapq.heappush(heap, (d, of_column[j] >= 0, j))
        while heap and heap[0][2] in done:
            heapq.heappop(heap)
        if not heap or heap[0][0] >= give_up:
            least = give_up
            break
        here, taken, j = heapq.heappop(heap)
        done[j] = here
        if not taken:
            least, goal = here, j
            break
        i = of_column[j]
        rows.append((i, here))
        if here + far - price[i] < give_up:
            give_up, loser = here + far - price[i], i
    for i, d in rows:
        if d < least:
            price[i] += least - d
    for j, d in done.items():
        if d < least:
            value[j] -= least - d
    if goal < 0:
        goal, of_row[loser] = of_row[loser], -1
        if loser == row:
            return
    while True:
        i = back[goal]
        of_column[goal], of_row[i], goal = i, goal, of_row[i]
        if i == row:
            return


def _rows_of(i: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))])


def _solve(edges: pd.DataFrame, cost: str) -> pd.DataFrame:
    edges = edges.sort_values(["src_idx", "ref_idx"])
    s, r = np.unique(edges.src_idx), np.unique(edges.ref_idx)
    i, j, c = np.searchsorted(s, edges.src_idx), np.searchsorted(r, edges.ref_idx), edges[cost].to_numpy(float)
    far = float(c.max()) * (min(len(s), len(r)) + 1) + 1.0  # a pair more is worth any costs of the component
    column, _, _ = sparse_assignment(_rows_of(i, len(s)), j, c, len(r), far)
    return edges[column[i] == j]


def optimal(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Most pairs first, then least cost: the graph's components are solved one by one, as both add up over them."""
    e = checkpointed(edges.select("src_idx", "ref_idx", "d", cost))
    links = e.select((F.col("src_idx") * 2).alias("a"), (F.col("ref_idx") * 2 + 1).alias("b"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    part = labelled(nodes, links).select((F.col("node") / 2).cast("long").alias("src_idx"), "label", (F.col("node") % 2).alias("side")).filter("side = 0").drop("side")
    return e.join(part, "src_idx").groupBy("label").applyInPandas(lambda f: _solve(f, cost)[["src_idx", "ref_idx", "d", cost]], f"src_idx long, ref_idx long, d double, {cost} double")


def match(src: DataFrame, ref: DataFrame, config: Config = Config(), src_label: str = "src", ref_label: str = "ref") -> MatchResult:
    method = config.match_method
    edges = candidates(src, ref, config, 20 if method == "optimal" else 5)
    pairs = optimal(edges) if method == "optimal" else greedy(edges)
    score = "cost" if method == "optimal" else "score"
    return assemble(pairs.withColumnRenamed(score, "match_score"), src, ref, config, src_label, ref_label)


def assemble(pairs: DataFrame, src: DataFrame, ref: DataFrame, config: Config, src_label: str, ref_label: str) -> MatchResult:
    chosen = checkpointed(pairs.select("src_idx", "ref_idx", F.col("d").alias("match_distance"), "match_score"))
    flagged = ambiguity(chosen, src, ref, config.ambiguity_radius_um)
    wide = chosen.join(flagged, "src_idx", "left")
    for df, key, label in ((src, "src_idx", src_label), (ref, "ref_idx", ref_label)):
        wide = wide.join(df.select(F.col("row_idx").alias(key), *[F.col(c).alias(f"{label}_{c}") for c in df.columns if c != "row_idx"]), key)
    return MatchResult(wide, stats(chosen, src, ref), src.join(chosen, src["row_idx"] == chosen["src_idx"], "left_anti"), ref.join(chosen, ref["row_idx"] == chosen["ref_idx"], "left_anti"))


def stats(matched: DataFrame, src: DataFrame, ref: DataFrame) -> DataFrame:
    n = src.agg(F.count("*").alias("n_src")).crossJoin(ref.agg(F.count("*").alias("n_ref")))
    d = "match_distance"
    m = matched.agg(F.count("*").alias("n_matched"), F.avg(d).alias("mean_distance"), F.median(d).alias("median_distance"), F.max(d).alias("max_distance"))
    rate = lambda of: F.when(F.col(of) > 0, F.col("n_matched") / F.col(of)).otherwise(0.0)
    return n.crossJoin(m).select("n_src", "n_ref", "n_matched", (F.col("n_src") - F.col("n_matched")).alias("n_unmatched_src"), (F.col("n_ref") - F.col("n_matched")).alias("n_unmatched_ref"), rate("n_src").alias("src_rate"), rate("n_ref").alias("ref_rate"), "mean_distance", "median_distance", "max_distance")


def ambiguity(matched: DataFrame, src: DataFrame, ref: DataFrame, radius: float = 50.0) -> DataFrame:
    """n_ref_candidates within the radius, next_best_distance (any other reference), ambiguity_score and flag.

    The next best is looked for in growing rings: only sources that have none yet are joined again, with cells
    twice as wide, until there are none or the cells hold the whole extent.
    """
    left = checkpointed(src.select(F.col("row_idx").alias("src_idx"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y")).join(matched.select("src_idx", F.col("ref_idx").alias("own"), "match_distance"), "src_idx"))
    right = ref.select(F.col("row_idx").alias("ref_idx"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    ends = left.select("x", "y").unionByName(right.select("x", "y")).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]).first()
    extent = 0.0 if ends.min_x is None else float(np.hypot(ends.max_x - ends.min_x, ends.max_y - ends.min_y))
    near = spatial.within(left, right, radius, radius).groupBy("src_idx").agg(F.count("*").alias("n_ref_candidates"))
    todo, reach, best = left.select("src_idx", "own", "x", "y"), 2 * radius, None
    while todo.limit(1).count():
        other = spatial.within(todo, right, reach, reach).filter(F.col("ref_idx") != F.col("own"))
        found = checkpointed(other.groupBy("src_idx").agg(F.min("d").alias("next_best_distance")))
        best = found if best is None else best.unionByName(found)
        if reach >= extent:
            break
        todo, reach = checkpointed(todo.join(found, "src_idx", "left_anti")), 2 * reach
    out = left.select("src_idx", "match_distance").join(near, "src_idx", "left")
    out = out.join(best, "src_idx", "left") if best is not None else out.withColumn("next_best_distance", F.lit(None).cast("double"))
    n, b = F.coalesce("n_ref_candidates", F.lit(0)).cast("long"), F.col("next_best_distance")
    score = F.when(b > 0, F.col("match_distance") / b).otherwise(0.0)
    return out.select("src_idx", n.alias("n_ref_candidates"), b, score.alias("ambiguity_score"), ((score > 0.7) | (n >= 3)).alias("ambiguity_flag"))


def composites(src: DataFrame, ref: DataFrame, factor: float = 1.5, base: float = 100.0) -> DataFrame:
    """Sources that several unmatched references together explain by area."""
    radius = F.when(F.col("major_um") > 0, factor * F.col("major_um") / 2).otherwise(base)
    cell = src.agg(F.max(radius)).first()[0] or base
    left = src.filter("area_um2 > 0").select(F.col("row_idx").alias("src_idx"), F.col("particle_id").alias("src_particle_id"), F.col("area_um2").alias("src_area"), radius.alias("radius"), F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y"))
    right = ref.select(F.col("row_idx").alias("ref_idx"), F.col("particle_id").alias("ref_id"), F.col("area_um2").alias("ref_area"), F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))
    found = spatial.within(left, right, F.col("radius"), cell).groupBy("src_idx", "src_particle_id", "src_area").agg(F.count("*").alias("n_ref_parts"), F.sort_array(F.collect_list(F.struct("ref_idx", "ref_id"))).alias("parts"), F.sum("ref_area").alias("combined_area"))
    ratio = F.col("combined_area") / F.col("src_area")
    return found.filter((F.col("n_ref_parts") >= 2) & (F.col("combined_area") > 0) & ratio.between(0.3, 5)).select("src_particle_id", "n_ref_parts", F.concat_ws(";", "parts.ref_id").alias("ref_ids"), "combined_area", "src_area", F.round(ratio, 3).alias("area_ratio"))


def triplets(fr: DataFrame, lr: DataFrame) -> DataFrame:
    """Source and third particle that share a reference; fr and lr have ref_idx. One row for each such pair."""
    return fr.join(lr, "ref_idx")


def size_edges(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Costs of all pairs of a tile (columns by; without any, of the tables) by size alone."""
    keys = [F.col(c) for c in by]
    left = a.select(*keys, F.col("row_idx").alias("src_idx"), F.col("area_um2").alias("sa"), F.col("feret_max_um").alias("sf"))
    right = b.select(*keys, F.col("row_idx").alias("ref_idx"), F.col("area_um2").alias("ra"), F.col("feret_max_um").alias("rf"))
    pairs = left.join(right, list(by)) if by else left.crossJoin(right)
    return pairs.select(*by, "src_idx", "ref_idx", size_cost(F.col("sa"), F.col("ra"), F.col("sf"), F.col("rf")).alias("cost"))


#: Cheapest partners of each row that size_assignment() begins with, and those that a round adds at most.
NEAREST, MORE = 64, 16
#: Pairs whose costs are held at once.
HELD = 1 << 22


def _size_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """size_cost() of all pairs of rows (log area, log feret)."""
    area, feret = (np.abs(a[:, None, k] - b[None, :, k]) for k in (0, 1))
    return np.nan_to_num(area, copy=False) + 0.5 * np.nan_to_num(feret, copy=False)


def size_assignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column (row of b) of each row of a at least total cost of all pairs (rows <= columns).

    Solved over each row's cheapest columns; then the prices are held against all pairs, and those that undercut them
    join the next round. When there are none, no pair that was left out can lower the total.
    """
    n, m, step = len(a), len(b), max(1, HELD // max(1, len(b)))
    if not n:
        return np.zeros(0, np.int64)
    blocks = [slice(k, k + step) for k in range(0, n, step)]
    row, column, cost = [], [], []

    def add(value: np.ndarray, costs: np.ndarray, rows: np.ndarray, most: int, limit: float) -> None:
        at = np.argpartition(value, most - 1, 1)[:, :most] if most < m else np.broadcast_to(np.arange(m), value.shape)
        below = np.take_along_axis(value, at, 1) < limit
        row.append(np.repeat(rows, at.shape[1]).reshape(at.shape)[below])
        column.append(at[below])
        cost.append(np.take_along_axis(costs, at, 1)[below])

    for k in blocks:
        costs = _size_costs(a[k], b)
        add(costs, costs, np.arange(n)[k], min(NEAREST, m), np.inf)
    while True:
        i, j, c = (np.concatenate(x) for x in (row, column, cost))
        order = np.lexsort((j, i))
        i, j, c = i[order], j[order], c[order]
        found, u, v = sparse_assignment(_rows_of(i, n), j, c, m, float(c.max(initial=0.0)) * (n + 1) + 1.0)
        before = sum(map(len, row))
        for k in blocks:
            costs = _size_costs(a[k], b)
            over = costs - v - u[k, None]
            low = np.flatnonzero(over.min(1) < -1e-9)
            if len(low):
                add(over[low], costs[low], np.arange(n)[k][low], min(MORE, m), -1e-9)
        if sum(map(len, row)) == before:
            return found


def size_join(a: DataFrame, b: DataFrame, most_cost: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """a with the coordinates and row_idx (coord_idx) of the b that an optimal assignment by size gives it; over most_cost there are none.

    by: columns of both that name a tile or field; each is a problem of its own, solved by one task in memory that
    follows the tile's rows, in time that follows its pairs.
    """
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    size = lambda c: F.log(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1e-6)))).alias(c)
    known = " and ".join(f"`{c}` is not null" for c in by) or "true"
    sides = [df.filter(known).select(*keys, "row_idx", size("area_um2"), size("feret_max_um")).groupBy(*(by or ("_all",))) for df in (a, b)]

    def solve(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        f, g = f.sort_values("row_idx"), g.sort_values("row_idx")
        x, y = (t[["area_um2", "feret_max_um"]].to_numpy(float) for t in (f, g))
        tall = len(x) > len(y)
        column = size_assignment(y, x) if tall else size_assignment(x, y)
        i, j = (column, np.arange(len(column))) if tall else (np.arange(len(column)), column)
        cost = np.nan_to_num(np.abs(x[i] - y[j])) @ [1.0, 0.5]
        return pd.DataFrame({"src_idx": f.row_idx.to_numpy()[i], "ref_idx": g.row_idx.to_numpy()[j], "cost": cost})

    pairs = sides[0].cogroup(sides[1]).applyInPandas(solve, "src_idx long, ref_idx long, cost double").filter(F.col("cost") <= most_cost)
    place = b.select(F.col("row_idx").alias("ref_idx"), F.col("x_um").alias("bx"), F.col("y_um").alias("by"))
    out = a.drop("x_um", "y_um").join(pairs.join(place, "ref_idx"), a["row_idx"] == pairs["src_idx"], "left")
    return out.select(*[c for c in a.columns if c not in ("x_um", "y_um")], F.col("bx").alias("x_um"), F.col("by").alias("y_um"), F.col("ref_idx").alias("coord_idx"), F.col("cost").alias("coord_match_cost"), F.when(F.col("cost").isNotNull(), "image").otherwise("none").alias("coord_source"))


def join_quality(joined: DataFrame) -> DataFrame:
    """Of size_join()'s result: joined, rejected, and the median and largest cost."""
    c = F.col("coord_match_cost")
    return joined.agg(F.count(c).alias("joined"), F.count_if(c.isNull()).alias("rejected"), F.median(c).alias("median_cost"), F.max(c).alias("max_cost"))


def affordable(pairs: DataFrame, most: float, cost: str = "cost") -> DataFrame:
    return pairs.filter(F.col(cost) <= most)


def first_hit(df: DataFrame, table: DataFrame, key: str, other: str, value: str, order: str) -> DataFrame:
    """df with the value of the first row of table whose other column equals key."""
    first = table.groupBy(F.col(other).alias(key)).agg(F.min_by(value, order).alias(value))
    return df.join(first, key, "left")


def consensus(fr: Column, lr: Column, fl: Column) -> Column:
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (fr, lr, fl)), F.lit(0))
    return n
