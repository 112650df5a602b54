"""From buckets to groups: what the two MinHash operators share once members have met.

`met` has a row for each member of a bucket of two or more: key, id, size (members of the
bucket). `marks` has id, n (elements) and bag (a byte for each of some MinHash draws over
the elements, 0 for a draw that has none), `texts` has id and _text. Bags are compared at
`alike`, a Jaccard similarity of the elements that similar texts have at least: a pair
passes if it shares no fewer draws than that says less SIGMAS standard deviations. A verify task says of pairs of texts whether they are similar;
similar members have element counts within the threshold's ratio of each other.

1. Leaders: every member is compared with its bucket's leader, first in a part of the
   buckets, then in all, then in all with other leaders: a pair a row at most, however
   large the bucket.
2. Every bucket that still holds more than one part is compared in full, so a link between
   two members that are both unlike their leaders isn't lost. Buckets whose best connected
   member is the same are one unit, as members that share one bucket mostly share many; a
   unit is compared once, with its texts at hand, large ones block by block. So pairs exist
   only inside a task, which keeps those that bags, counts and common elements allow,
   verifies them and returns the links that join parts: fewer than it has members. Only
   members of a unit's largest part aren't compared among themselves, as they are linked already.
3. Union-find after each step; what is in one part isn't compared again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_written, free_shuffles, lean, ragged, written
from quern.llm.components import united

#: One of so many buckets takes part in the first leader turn.
FIRST = 8
#: Leader turns over all buckets that follow.
TURNS = 2
#: Members on one side of a comparison in full, and bytes of their texts; larger units are cut into blocks, and all pairs
#: of blocks compared.
BLOCK, BYTES = 512, 8 << 20
#: Rows of one call of the comparison in full, of units that aren't cut.
PACK = 1024
#: One similar pair in 30,000 at the very threshold is further below.
SIGMAS = 4.0


def verified(pairs: DataFrame, texts: DataFrame, verify: Callable) -> DataFrame:
    """Of the distinct pairs (a, b) of ids, those whose texts are similar."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("_text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("_text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _least(draws, alike: float):
    """How many of the draws that either has a pair shares at least; a Column or an array."""
    root = draws**0.5 if isinstance(draws, np.ndarray) else F.sqrt(draws)
    return alike * draws - SIGMAS * (alike * (1 - alike)) ** 0.5 * root


def _passes(x: str, y: str, alike: float):
    count = lambda f: F.aggregate(F.zip_with(x, y, lambda p, q: f(p, q).cast("int")), F.lit(0), lambda n, e: n + e)
    return count(lambda p, q: (p == q) & (p != 0)) >= _least(count(lambda p, q: (p != 0) | (q != 0)), alike)


def _counted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many draws each row of x shares with each row of y, and how many either has."""
    same, equal = np.zeros((len(x), len(y)), np.uint8), np.empty((len(x), len(y)), bool)
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        np.equal(p[:, None], q[None], out=equal)
        np.add(same, equal.view(np.uint8), out=same)
    neither = ((x == 0).astype(np.float32) @ (y == 0).astype(np.float32).T).astype(np.uint8)  # equal, but not shared
    same -= neither
    return same, np.uint8(x.shape[1]) - neither


def _pairs_task(threshold: float, alike: float):
    """Pairs (a < b) of the first and second members of each unit whose parts differ and that may be similar."""

    def run(key, table):
        rows = table.num_rows
        ids, part, n, unit = (table.column(c).to_numpy() for c in ("id", "part", "n", "unit"))
        first, second = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
        bag = table.column("bag").combine_chunks().flatten().to_numpy().reshape(rows, -1)
        order = np.lexsort((n, unit))
        out = [(ids[:0], ids[:0], n[:0])]
        for members in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            x, y = members[first[members]], members[second[members]]
            # Members of the largest part are linked: within one block, they need not ask, only be asked.
            names, of = np.unique(part[members], return_inverse=True)
            whole = bool((first[members] & second[members]).all())
            main = names[np.bincount(of).argmax()]
            x = x[part[x] != main] if whole else x
            long = n[y]
            for i in (x[at : at + 256] for at in range(0, len(x), 256)):
                low, high = np.searchsorted(long, [threshold * n[i[0]] - 1e-6, n[i[-1]] / threshold + 1e-6])
                j = y[low:high]
                same, either = _counted(bag[i], bag[j])
                p, q = np.nonzero(same >= _least(either.astype(np.float32), alike))
                shared, p, q = 100.0 * same[p, q] / np.maximum(either[p, q], 1), i[p], j[q]
                ok = (part[p] != part[q]) & (np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q]) - 1e-9)
                ok &= (ids[p] < ids[q]) | (part[q] == main) if whole else True  # within one block, each pair once
                p, q = p[ok], q[ok]
                out.append((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), shared[ok].astype(np.int32)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "shared"])

    return run


def _placed(met: DataFrame, parts: DataFrame) -> DataFrame:
    return met.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id")


def _led(met: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's leader of this turn and the members of other parts.

    First leaders are the members that meet most others: of variants of one original, that is the original, which is
    nearer to all of them than they are to each other. The last turn's are drawn by a hash of the id.
    """
    name = F.xxhash64("id", F.lit(turn)).bitwiseAND(F.lit(0xFFFFFFFF))
    known = F.least("meets", F.lit((1 << 31) - 1)) if turn < TURNS else F.lit(0)
    placed = _placed(met, parts).withColumn("draw", F.shiftleft(known.cast("long"), 32).bitwiseOR(name))
    top = placed.groupBy("key").agg(F.max("draw").alias("draw"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q")
    leaders = placed.join(top.select("key", "draw"), ["key", "draw"], "left_semi").select(F.col("key").alias("k"), F.col("id").alias("a"), F.col("part").alias("part_a"))
    return placed.join(leaders, (F.col("key") == F.col("k")) & (F.col("part") != F.col("part_a"))).select("a", F.col("id").alias("b")).distinct()


def _likely(pairs: DataFrame, marks: DataFrame, threshold: float, alike: float) -> DataFrame:
    """Of the pairs (a, b), those whose counts and bags allow the similarity; no text is moved for the others."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bag").alias(f"bag_{side}")), side)
    counts = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return pairs.filter(counts & _passes("bag_a", "bag_b", alike)).select("a", "b")


def _common(values: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements texts x and y have in common; values are the elements of all texts, each text's without repeats."""
    out = np.zeros(len(x), np.int64)
    names, code = np.unique(values, return_inverse=True)
    begins, has = np.cumsum(counts) - counts, np.zeros(len(names), bool)
    order = np.argsort(x, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else []:
        i = x[pairs[0]]
        own = code[begins[i] : begins[i] + counts[i]]
        has[own] = True
        sizes = counts[y[pairs]]
        sums = np.concatenate([[0], np.cumsum(has[ragged(code, begins[y[pairs]], sizes)])])
        ends = np.cumsum(sizes)
        out[pairs] = sums[ends] - sums[ends - sizes]
        has[own] = False
    return out


def _links_task(threshold: float, alike: float, elements: Callable):
    """Links (a, b) of the units in a pack that join parts."""
    compared = _pairs_task(threshold, alike)

    def run(key, table):
        pairs = compared(key, table)
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
        out: list[tuple[int, int]] = []
        if len(a):
            code = np.unique(np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b), return_index=True)[1]
            code = code[np.argsort(-pairs.column("shared").to_numpy()[code], kind="stable")]
            some, each = np.unique(np.concatenate([np.searchsorted(ids, a[code]), np.searchsorted(ids, b[code])]), return_inverse=True)
            x, y = np.split(each, 2)
            values, counts, least, similar = elements(table.column("_text").take(pa.array(at[some])).combine_chunks())
            likely = np.flatnonzero(_common(values, counts, x, y) >= least(counts[x], counts[y]))
            root = {p: p for p in table.column("part").to_pylist()}
            part = table.column("part").to_numpy()[at[some]].tolist()

            def find(p):
                while root[p] != p:
                    root[p] = p = root[root[p]]
                return p

            for i, j in zip(x[likely].tolist(), y[likely].tolist(), strict=True):
                p, q = find(part[i]), find(part[j])
                if p != q and similar(i, j):
                    root[p] = q
                    out.append((int(ids[some[i]]), int(ids[some[j]])))
        lean()
        return pa.table([pa.array([c[k] for c in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _rest(met: DataFrame, marks: DataFrame, texts: DataFrame, parts: DataFrame, elements: Callable, threshold: float, alike: float) -> DataFrame:
    """Links (a, b) that join the parts of members of a bucket.

    A unit of at most BLOCK members and BYTES of text is compared as it is. A larger one is cut by count, by whether a
    member is of the unit's largest part, and by a hash of the id; two blocks are a unit if their counts allow the similarity.
    """
    placed = _placed(met, parts)
    best = F.max(F.struct("meets", "id"))
    keys = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), best.alias("best")).filter("p < q")
    some = placed.join(keys.select("key", F.xxhash64("best.id").alias("unit")), "key").select("unit", "id", "part").distinct()
    sized = texts.select("id", "_text", F.octet_length("_text").alias("bytes"))
    rows = written(some.join(marks, "id").join(sized, "id"), "apart")
    columns = ["id", "n", "part", "bag", "_text"]
    sizes = rows.groupBy("unit").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    sizes = written(sizes.withColumn("cut", (F.col("m") > BLOCK) | (F.col("bytes") > BYTES)), "units")
    whole = sizes.filter("not cut").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    packs = max(1, whole.m // PACK, whole.bytes // BYTES)
    every = rows.join(sizes.filter("not cut").select("unit"), "unit", "left_semi")
    every = every.select(*columns, "unit", F.lit(True).alias("first"), F.lit(True).alias("second"), F.pmod("unit", F.lit(packs)).alias("pack"))
    if sizes.filter("cut").limit(1).count():
        large = rows.join(sizes.filter("cut").select("unit"), "unit", "left_semi").withColumnRenamed("unit", "key")
        main = large.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"))
        # Of two counts in steps of the threshold, those that allow the similarity are neighbours.
        step = F.floor(F.log(F.col("n")) / (1e-6 - math.log(threshold)))
        large = large.join(main.select("key", F.col("top.part").alias("main")), "key").select("key", "bytes", *columns, step.alias("step"), (F.col("part") == F.col("main")).alias("is_main"))
        kind = ["key", "step", "is_main"]
        cuts = large.groupBy(*kind).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BYTES)).alias("cuts"))
        cuts = written(cuts, "cuts")
        block = F.pmod(F.xxhash64("id", "key"), F.col("cuts")).alias("block")
        large = large.join(cuts, kind).select(*kind, block, *columns)
        blocks = cuts.select(*kind, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("block"))
        name = [*kind[1:], "block"]
        other = blocks.select("key", *[F.col(c).alias(f"{c}_2") for c in name])
        mine, its = F.struct(*name), F.struct(*[f"{c}_2" for c in name])
        units = blocks.join(other, "key").filter((mine <= its) & (F.abs(F.col("step") - F.col("step_2")) <= 1) & ~(F.col("is_main") & F.col("is_main_2")))
        units = written(units.withColumns({"unit": F.xxhash64("key", mine, its), "own": mine == its}), "units")
        sides = units.select(*kind, "block", "unit", F.lit(True).alias("first"), F.col("own").alias("second"))
        theirs = units.filter("not own").select("key", *[F.col(f"{c}_2").alias(c) for c in name], "unit", F.lit(False).alias("first"), F.lit(True).alias("second"))
        cut = large.join(sides.unionByName(theirs), [*kind, "block"]).select(*columns, "unit", "first", "second", F.col("unit").alias("pack"))
        every = every.unionByName(cut)
    return every.groupBy("pack").applyInArrow(_links_task(threshold, alike, elements), "a long, b long")


def linked(met: DataFrame, marks: DataFrame, texts: DataFrame, verify: Callable, elements: Callable, threshold: float, alike: float) -> DataFrame:
    """node, component of every member, all links between members of a bucket verified.

    elements: of an array of texts, the hashed elements of all of them without repeats within a text and how many each
    has, how many texts of so many elements share at least, and whether texts i and j are similar.
    """
    spark = met.sparkSession
    met = written(met.join(met.groupBy("id").agg(F.sum("size").alias("meets")), "id"), "met")
    parts = written(met.select(F.col("id").alias("node"), F.col("id").alias("component")).distinct(), "parts")
    for turn in range(TURNS + 1):
        some = met.filter(F.pmod("key", F.lit(FIRST)) == 0) if turn == 0 else met.filter("size > 2") if turn == TURNS else met
        pairs = written(_likely(_led(some, parts, turn), marks, threshold, alike).hint("rebalance"), "pairs")
        last, parts = parts, united(parts, verified(pairs, texts, verify))
        drop_written(pairs)
        drop_written(last)
    free_shuffles(spark)
    links = written(_rest(met, marks, texts, parts, elements, threshold, alike), "rest")
    free_shuffles(spark)
    return united(parts, links)
