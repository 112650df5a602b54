import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import near
from quern.llm import order_minhash as o
from quern.llm.decontaminate import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 12))
def test_banded_distance(a, b, most):
    assert o.banded_distance(np.array(a, int), np.array(b, int), most) == min(distance(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1é \n-", max_size=20), min_size=1, max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    hashes, counts = o.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    alone = [h for r in raw for h in o.word_hashes(np.frombuffer(r, np.uint8), np.zeros(1, int), np.array([len(r)]))[0].tolist()]
    assert hashes.tolist() == alone
    seen = {}
    for w, h in zip([w for t in texts for w in words_of(t)], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h


def say(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_groups(spark):
    rng = random.Random(2)
    docs, truth = [], {}
    for k in range(40):
        base = say(rng, rng.randrange(6, 300))
        for c in range(rng.choice([1, 1, 2, 9])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.04]))):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(["zz", "yy"])] * rng.choice([0, 1])
            docs.append((len(docs), " ".join(w).title() if c % 2 else ", ".join(w)))
    passage = say(rng, 60)  # shared by documents that aren't similar
    for _ in range(30):
        docs.append((len(docs), " ".join(say(rng, 90) + passage)))
    docs += [(900, None), (901, ""), (902, "-- !"), (903, "two words"), (904, "Two  words."), (905, "two other words"), (906, "one"), (906, "one")]
    texts = {i: words_of(t) for i, t in docs}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            a, b = texts[i], texts[j]
            if i < j and a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a) & set(b)) > 0.5 * len(set(a)) and distance(a, b) <= 0.2 * max(len(a), len(b)):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, keys string")
    got = {r.doc_id: r for r in o.report(df).collect()}
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in texts}
    assert got[904].class_id == 903 and got[906].kept
    kept = o.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in texts})
    assert o.report(df.limit(0)).count() == 0
    odd = o.report(spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.group_id or 0, r.kept) for r in odd.collect()) == [(0, 0, True), (0, 0, True), (4, 4, True)]


def test_members_unlike_the_smallest(spark, monkeypatch):
    """Two near copies that meet only in a bucket whose smallest member is unlike both."""
    rng = random.Random(4)
    passage, rest = say(rng, 300), say(rng, 120)
    docs = [(0, " ".join(passage)), (1, " ".join(passage + rest)), (2, " ".join(passage + rest[:-4] + ["q", "r"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in o.report(df).collect()} == {0: 0, 1: 1, 2: 1}


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    """Near copies in pairs, all in the buckets of one passage, each pair unlike the rest; a bucket is many blocks."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(6)
    passage, docs = say(rng, 150), []
    for k in range(60):
        rest = say(rng, 80 + k % 30)
        docs += [(2 * k, " ".join(passage + rest)), (2 * k + 1, " ".join(passage + [x if i % 4 else f"q{k}" for i, x in enumerate(rest)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {i: t.split() for i, t in docs}
    want = {i: i - i % 2 if distance(texts[i], texts[i - i % 2]) <= 0.2 * max(len(texts[i]), len(texts[i - i % 2])) else i for i in texts}
    assert len(set(want.values())) < len(want)
    assert {r.doc_id: r.group_id for r in o.report(df).collect()} == want


def test_rows_without_an_id_or_with_one_id_stay(spark):
    rows = [(None, "one text"), (None, "quite another"), (1, "some words here"), (1, "Some words, here"), (1, "nothing like it"), (2, "alone")]
    got = o.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), "".join(c for c in r.text.lower() if c != ",")) for r in got) == [("1", "nothing like it"), ("1", "some words here"), ("2", "alone"), ("None", "one text"), ("None", "quite another")]


def test_recall_near_the_threshold():
    """Pairs with 15 to 20 % of their words replaced at random meet in 9 of 10 cases or more, and bags drop none of them."""
    rng = random.Random(11)
    for words in (60, 300):
        for share in (0.15, 0.18, 0.2):
            met = alike = 0
            for _ in range(200):
                a = say(rng, words)
                b = list(a)
                for i in rng.sample(range(words), int(share * words)):
                    b[i] = f"x{rng.randrange(10**6)}"
                raw = [" ".join(x).encode() for x in (a, b)]
                sizes = np.array([len(r) for r in raw])
                hashes, counts = o.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
                met += bool((np.equal(*o.sketches(hashes, counts))).any())
                alike += int(np.equal(*o.bags(hashes, counts)).sum() >= near._least(np.array([o.BAG]), o.ALIKE)[0])
            assert met >= 0.87 * 200 and alike == 200, (words, share, met, alike)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = say(rng, 60_000)
    docs = [(1, " ".join(long)), (2, " ".join(long[:100] + ["x"] * 50 + long[150:])), (3, " ".join(long[:40_000])), (4, "short text")]
    got = {r.doc_id: r.group_id for r in o.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
