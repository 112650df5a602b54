import hashlib
import random
import re

import pytest

from quern.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for win in [v] if 0 < len(v) < window else [v[k : k + window] for k in range(len(v) - window + 1)]:
                for k in range(len(w) - len(win) + 1):
                    if win and w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("group", [1 << 20, 60])
def test_brute_force(spark, group):
    rng = random.Random(5)
    vocab = ["a", "b", "Ä", "c9", "É-x"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 4, 9, 10, 11, 25]))) for k in range(12) if k] + [(99, None), (98, "zz zz zz"), (97, "zz"), (96, say(12)), (96, None)]
    docs = [(k, say(rng.randrange(0, 60)) + rng.choice(["", " Zz, zz\nzz", " zz", items[-2][1]])) for k in range(40)] + [(50, None), (51, ""), (52, "!!")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.match(df, bench, group_bytes=group)
    want = brute(docs, items)
    for r in found.collect():
        hit = {k for s in r.spans for k in range(s.begin, s.end)}
        ids = r["items"]
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))
        assert (r.n_words, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) == want[r.doc_id]
    for r in d.report(df, bench).collect():
        assert tuple(r)[1:] == want[r.doc_id]
    clean = d.remove(df, bench)
    assert clean.columns == df.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    for i, t in docs:
        assert got[i] == t if not want[i][1] else len(words(got[i])) == want[i][0] - want[i][1]


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:3] for r in d.report(docs, bench).collect()] == [(2, 0)]
    assert d.report(docs.limit(0), bench).count() == 0


def test_a_window_of_many_items_and_a_very_long_text(spark):
    """A stock phrase in 3,000 items, in a text that holds it 2,000 times; null ids on both sides."""
    phrase = " ".join(f"stock{i}" for i in range(12))
    items = [(f"i{k}", f"{phrase} own{k}") for k in range(3000)] + [(None, "only the item without an id says these ten or eleven words")]
    docs = [(1, f"{phrase} filler " * 2000), (None, phrase), (2, items[-1][1]), (3, "nothing " * 20)]
    got = {r.doc_id: r for r in d.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (26000, 24000, 3000)
    assert (got[None].n_hit, got[None].n_items) == (12, 3000)
    assert got[2].n_hit == got[2].n_words and got[2].n_items == 0 and got[2].contaminated and not got[3].contaminated


def test_further_passes(spark, monkeypatch):
    """With more automata than are sent at once, what is found is the same."""
    monkeypatch.setattr(d, "SENT", 1)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(11))) for k in range(4)]
    docs = [(k, f"before {t} after") for k, t in items] + [(9, "none")]
    got = d.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [(0, 11, 1), (1, 11, 1), (2, 11, 1), (3, 11, 1), (9, 0, 0)]
    again = d.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), group_bytes=60).collect()
    assert sorted(sum(s.end - s.begin for s in r.spans) for r in again) == [0, 11, 11, 11, 11]
