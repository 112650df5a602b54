import hashlib
import random

import pytest

from quern.llm import substrings as s


def brute(docs, length=50):
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        smaller = {r[k : k + length] for j, t in docs if (j if j is not None else 1e30) < (i if i is not None else 1e30) for r in [(t or "").encode()] for k in range(len(r) - length + 1)}
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in smaller:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def say(rng, n):
    return " ".join(rng.choice(["the", "of", "ñandú", "ab", "abab", "x" * 9, "qrst"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(s, "BUCKET", 4000)
    rng = random.Random(seed)
    base = [say(rng, rng.randrange(1, 120)) for _ in range(12)]
    docs = []
    for k in range(90):
        parts = [rng.choice(base) for _ in range(rng.randrange(0, 3))] + [say(rng, rng.randrange(0, 30))]
        text = list(" ".join(parts))
        for _ in range(rng.randrange(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice("é\0z")
        docs.append((rng.randrange(200), "".join(text)))
    docs = list({d[0]: d for d in docs}.values()) + [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 300), (504, "ab" * 100), (505, "b" + "ab" * 60), (None, base[0] + base[1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, bucket string").repartition(5)
    assert sorted((tuple(r) for r in s.digest(df).collect()), key=str) == brute(docs)


def test_one_id_twice(spark):
    a, b = say(random.Random(1), 40), say(random.Random(2), 40)
    docs = [(1, a), (1, b), (2, b + a), (2, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in s.digest(df).collect()), key=str) == brute(docs)
    assert s.digest(df.limit(0)).count() == 0


def test_hash_as_in_sql(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    got = [r.h for r in spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "i long, k long").selectExpr("k", "xxhash64(i) h").orderBy("k").collect()]
    assert s.xxhash64(s.np.array(ids)).tolist() == got
