import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lm_score as q


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    nouns = {"a": [f"n{i}" for i in range(60)], "b": [f"m{i}" for i in range(60)]}
    docs = []
    for i in range(n):
        kind = nouns[rng.choice("ab")]
        docs.append((i, " ".join(f"the {rng.choice(kind)} sees {rng.choice(kind)}" for _ in range(rng.randrange(1, 40))) + rng.choice(["", f" Rare{i}"])))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \x1c "), (n + 2, " \x1c ")]


@pytest.mark.parametrize("head", [10_000, 50])
def test_contract(spark, head, monkeypatch):
    monkeypatch.setattr(q, "HEAD", head)
    monkeypatch.setattr(q, "SINGLES", 20)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in q.digest(df).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*q.words_of(t or ""), None])
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        tokens = [*q.words_of(t or ""), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
    assert q.digest(df.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = [(i, t or "") for i, t in corpus(80)]
    vocabulary, model, counts = q.fit(spark.createDataFrame(docs, "i long, text string").select("text"))
    near, far, normal = model.tables()
    p = np.exp(near[:, None, :] + far[None, :, :] - normal[:, :, None]).sum(2)
    assert np.abs(p - 1).max() < 1e-3
    # Within a class, the seen words and the unseen one.
    total = np.zeros(vocabulary.size)
    for w, c in ((r.w.encode(), r.c) for r in counts.collect()):
        at, k = vocabulary.classes([w])
        total[k[0]] += (1 - vocabulary.new[k[0]]) * c / max(1, vocabulary.class_totals[k[0]])
    some = vocabulary.class_totals > 0
    some[q.END] = False
    assert np.allclose((total + vocabulary.new)[some], 1)


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = q.score(df, F.lit(False)).collect()[0]
    assert r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)
