import random
import zlib

import numpy as np

from quern.llm import toxicity as x


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "su", "ka"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(1, 160))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "Scum", "rotten.", "filth"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_gradients():
    net = x.Network({b"a": 1, b"b": 2}, np.array([0, 1, -1], np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, _ = net.windows([[b"a", b"b", b"c"] * 3, [b"b"] * 40, [b"c"]])
    y, w = (np.arange(len(at)) % 2).astype(float), np.linspace(0.5, 2, len(at))

    def loss():
        x_, _ = net._vectors(net.rows)
        inputs = x_ @ np.concatenate([net.p["wf"], net.p["wb"]], 1) + np.concatenate([net.p["cf"], net.p["cb"]])
        z = net._forward(inputs, at, False)[0].astype(float)
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean())

    g = net._gradients(at, y, w)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in {int(np.abs(g[name]).argmax()), int(rng.integers(flat.size))}:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[name].reshape(-1)[k]) < 2e-3, name


def test_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(-1, None, "x"), (-2, "", "x"), (-2, "", "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in x.digest(df, lab).collect()}
    assert len(got) == len(docs) + 2
    truth = {i: t for i, _, t in labels}
    held = [r for i, r in got.items() if i >= 0 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert not got[-1].predicted and not got[-2].predicted


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in x.digest(df, none).collect()] == [0.5]
    assert x.digest(df.limit(0), none).count() == 0
