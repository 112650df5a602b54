"""The comparison in full against one pair after another."""

import numpy as np
import pyarrow as pa

from quern.llm import lines, near


def members(rng, k, draws):
    base = rng.integers(0, 256, draws)
    bag = np.where(rng.random((k, draws)) < 0.3, rng.integers(0, 256, (k, draws)), base).astype(np.uint8)
    bag[rng.random((k, draws)) < 0.1] = 0
    return bag.view(np.int8)


def test_pairs_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(8):
        k, draws = 60, 64
        ids, n, unit, bag = rng.permutation(500)[:k], rng.integers(90, 130, k), rng.integers(0, 3, k), members(rng, k, draws)
        part = np.where(rng.random(k) < 0.5, 5, ids)
        first = (unit < 2) | (rng.random(k) < 0.5)
        second = (unit < 2) | ~first
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * draws), pa.array(bag.ravel()))
        table = pa.table({"id": pa.array(ids), "n": pa.array(n.astype(np.int32)), "part": pa.array(part), "bag": lists, "unit": pa.array(unit), "first": first, "second": second})
        got = near._pairs_task(0.8, 2 / 3)(None, table).to_pandas()
        want = set()
        for i in range(k):
            for j in range(k):
                if unit[i] != unit[j] or not (first[i] and second[j]) or ids[i] == ids[j] or part[i] == part[j] or min(n[i], n[j]) < 0.8 * max(n[i], n[j]) - 1e-9:
                    continue
                same, either = int(((bag[i] == bag[j]) & (bag[i] != 0)).sum()), int(((bag[i] != 0) | (bag[j] != 0)).sum())
                if same >= near._least(np.array([either], np.float32), 2 / 3)[0]:
                    want.add((min(ids[i], ids[j]), max(ids[i], ids[j]), int(100 * same / max(either, 1))))
        rows = list(got.itertuples(index=False, name=None))
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_linked_bucket_isnt_compared_with_itself(monkeypatch):
    """All but two members are one part: only those two ask."""
    rng, asked = np.random.default_rng(5), []
    counted = near._counted
    monkeypatch.setattr(near, "_counted", lambda x, y: asked.append(len(x) * len(y)) or counted(x, y))
    k, draws = 1000, 128
    bag = members(rng, k, draws)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * draws), pa.array(bag.ravel()))
    part = np.zeros(k, np.int64)
    part[[3, 700]] = 3, 700
    every = np.ones(k, bool)
    table = pa.table({"id": pa.array(np.arange(k)), "n": pa.array(np.full(k, 100, np.int32)), "part": pa.array(part), "bag": lists, "unit": pa.array(np.zeros(k, np.int64)), "first": every, "second": every})
    near._pairs_task(0.8, 0.8)(None, table)
    assert sum(asked) == 2 * k


def test_the_comparison_in_full_returns_links_not_pairs():
    """80 members whose bags are alike, of which the texts of two pairs are similar: two links leave the task, for a cycle one less."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(80)]
    texts[50], texts[60], texts[70], texts[71] = texts[5][:-1] + "x", texts[6][:-1] + "y", texts[7][:-1] + "z", texts[7][:-2] + "zz"
    k, draws = len(texts), 128
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * draws), pa.array(np.ones(k * draws, np.int8)))
    every, ids = np.ones(2 * k, bool), np.arange(k) * 3
    one = pa.table({"id": pa.array(ids), "n": pa.array(np.full(k, 57, np.int32)), "part": pa.array(ids), "bag": lists, "_text": pa.array(texts), "unit": pa.array(np.zeros(k, np.int64))})
    table = pa.concat_tables([one, one.set_column(5, "unit", pa.array(np.ones(k, np.int64)))]).append_column("first", pa.array(every)).append_column("second", pa.array(every))
    assert near._pairs_task(0.8, 0.8)(None, table).num_rows == k * (k - 1)  # each pair in both units
    got = near._links_task(0.8, 0.8, lines._elements(0.8))(None, table).to_pandas()
    part = {i: i for i in range(k)}
    for a, b in zip(got.a // 3, got.b // 3, strict=True):
        assert part[a] != part[b] and lines.similar_lines([texts[a]], [texts[b]], 0.8) == [True]
        part = {i: part[a] if p == part[b] else p for i, p in part.items()}
    assert len(got) == 4 and part[5] == part[50] and part[6] == part[60] and part[7] == part[70] == part[71]
