"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (for words of the training sample's vocabulary) beside
the mean vector of its character trigrams. A text is read in windows of WINDOW words
that overlap by half; each window passes a forward and a backward GRU, attention
pools the states, and a linear layer gives the window's logit. A text's logit is the
largest of its windows, all of which are scored, and two fitted numbers turn it into a
probability.

Labels are of whole texts, so training alternates: each toxic text of the sample gives
its highest window, other texts give their highest and random ones, and the network
(numpy, back-propagation through time, Adam) learns to tell them apart. Word vectors
start from the words' log odds in the sample.

The sample is bounded: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts outside the
held-out fold, by a hash of doc_id. Scoring is one pass without a shuffle.

Defined results: null and empty texts, and texts without words, are one empty window;
several labels of a document count as toxic if any is; without labels of both kinds
the score is the share of toxic labels (0.5 without any); repeated rows are scored one
by one; a null doc_id is held out if the empty text's crc32 is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, text_or_empty
from quern.llm.decontaminate import words_of

WINDOW, STEP = 24, 12
SAMPLE_TOXIC, SAMPLE_CLEAN = 900, 1800
VOCABULARY, TRIGRAMS, DIM_WORD, DIM_CHAR, HIDDEN, POOL = 20_000, 4096, 8, 8, 12, 12
ROUNDS, EPOCHS, BATCH, RATE = 3, 2, 256, 0.01
#: Words whose inputs a worker keeps; windows that are scored together.
CACHE, TOGETHER = 200_000, 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    return [zlib.crc32(w[i : i + 3]) % TRIGRAMS for i in range(max(1, len(w) - 2))]


class Network:
    def __init__(self, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = 1):
        """vocabulary: word -> 1..; row 0 is any other word. odds: a start for each row."""
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        d = DIM_WORD + DIM_CHAR
        small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"words": (0.05 * rng.normal(size=(len(vocabulary) + 1, DIM_WORD))).astype(np.float32), "chars": (0.05 * rng.normal(size=(TRIGRAMS, DIM_CHAR))).astype(np.float32)}
        self.p["words"][:, 0] = odds
        for side in "fb":
            self.p |= {f"w{side}": small(d, 3 * HIDDEN), f"u{side}": small(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": small(2 * HIDDEN, POOL), "q": small(POOL, 1)[:, 0], "v": small(2 * HIDDEN, 1)[:, 0], "o": np.full(1, -1, np.float32)}
        self.scale, self.shift = 1.0, 0.0
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}
        self.rows: list[tuple[int, list[int]]] = [(0, [0])]
        self.inputs = np.zeros((0, 6 * HIDDEN), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words in this network's list of known words, which grows."""
        index, rows = self.index, self.rows
        for w in set(words) - index.keys():
            index[w] = len(rows)
            rows.append((self.vocabulary.get(w, 0), trigrams(w)))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All windows of all texts as rows of word numbers (-1: nothing), and the first window of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([self.ids([w for t in texts for w in t]), np.full(WINDOW, -1)])
        many = np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1)
        first = np.cumsum(many) - many
        text = np.repeat(np.arange(len(texts)), many)
        inner = (np.arange(many.sum()) - first[text]) * STEP
        begin = (np.cumsum(sizes) - sizes)[text] + inner
        at = begin[:, None] + np.arange(WINDOW)
        out = flat[np.minimum(at, len(flat) - 1)]
        out[inner[:, None] + np.arange(WINDOW) >= sizes[text][:, None]] = -1
        return out, first

    def _vectors(self, rows: list[tuple[int, list[int]]]) -> tuple[np.ndarray, tuple]:
        word = np.array([r[0] for r in rows], np.int64)
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        flat = np.array([c for r in rows for c in r[1]], np.int64)
        chars = np.add.reduceat(self.p["chars"][flat], np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.concatenate([self.p["words"][word], chars], 1).astype(np.float32), (word, flat, sizes)

    def _forward(self, inputs: np.ndarray, at: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """Logits of windows. inputs: of each word, what both GRUs' input layers give; at: windows of rows of inputs."""
        n, there = len(at), (at >= 0)
        states, saved = np.empty((n, WINDOW, 2 * HIDDEN), np.float32), {}
        for k, side in enumerate("fb"):
            own, u = inputs[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], self.p[f"u{side}"]
            h, steps = np.zeros((n, HIDDEN), np.float32), []
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                x, g = own[at[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                old, h = h, np.where(there[:, t, None], new + z * (h - new), h)
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
                if keep:
                    steps.append((t, z, r, new, old, g[:, 2 * HIDDEN :]))
            saved[side] = steps
        pooled = np.tanh(states @ self.p["a"])
        e = pooled @ self.p["q"]
        e[~there] = -1e9
        e[:, 0] = np.where(there.any(1), e[:, 0], 0)
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        s = (w[:, None, :] @ states)[:, 0]
        return s @ self.p["v"] + self.p["o"], {"there": there, "states": states, "saved": saved, "pooled": pooled, "w": w, "s": s}

    def _gradients(self, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        if not len(used):
            return {}
        x, (word, flat, sizes) = self._vectors([self.rows[i] for i in used])
        wide = np.concatenate([self.p["wf"], self.p["wb"]], 1)
        inputs = x @ wide + np.concatenate([self.p["cf"], self.p["cb"]])
        logits, c = self._forward(inputs, local, True)
        d = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
        g = {"v": c["s"].T @ d, "o": d.sum(keepdims=True)}
        ds = d[:, None] * self.p["v"]
        dstates = c["w"][:, :, None] * ds[:, None, :]
        dw = (c["states"] @ ds[:, :, None])[:, :, 0]
        de = c["w"] * (dw - (c["w"] * dw).sum(1, keepdims=True))
        g["q"] = np.einsum("nt,ntk->k", de, c["pooled"])
        dpool = de[:, :, None] * self.p["q"] * (1 - c["pooled"] ** 2)
        g["a"] = np.einsum("ntk,ntj->kj", c["states"], dpool)
        dstates += dpool @ self.p["a"].T
        dinputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            u, dh, du = self.p[f"u{side}"], np.zeros((len(at), HIDDEN), np.float32), np.zeros_like(self.p[f"u{side}"])
            for t, z, r, new, old, gn in reversed(c["saved"][side]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = dh * c["there"][:, t, None]
                dnew = live * (1 - z) * (1 - new**2)
                dz = live * (old - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dnew * r], 1)
                np.add.at(dinputs[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], local[:, t][c["there"][:, t]], np.concatenate([dz, dr, dnew], 1)[c["there"][:, t]])
                du += old.T @ dg
                dh = dh * ~c["there"][:, t, None] + live * z + dg @ u.T
            g[f"u{side}"] = du
            part = dinputs[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            g[f"w{side}"], g[f"c{side}"] = x.T @ part, part.sum(0)
        dx = dinputs @ wide.T
        g["words"], g["chars"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["chars"])
        np.add.at(g["words"], word, dx[:, :DIM_WORD])
        np.add.at(g["chars"], flat, np.repeat(dx[:, DIM_WORD:] / sizes[:, None], sizes, 0))
        return g

    def logits(self, at: np.ndarray) -> np.ndarray:
        """Of windows, with the input layer's results kept for known words."""
        if len(self.inputs) < len(self.rows):
            x, _ = self._vectors(self.rows[len(self.inputs) :])
            wide = np.concatenate([self.p["wf"], self.p["wb"]], 1)
            new = x @ wide + np.concatenate([self.p["cf"], self.p["cb"]])
            self.inputs = np.concatenate([self.inputs, new.astype(np.float32)])
        return np.concatenate([self._forward(self.inputs, at[i : i + TOGETHER], False)[0] for i in range(0, len(at), TOGETHER)])

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self._forget()
        at, first = self.windows(texts)
        return _sigmoid(self.scale * np.maximum.reduceat(self.logits(at), first).astype(np.float64) + self.shift)

    def fit(self, texts: list[list[bytes]], labels: np.ndarray) -> "Network":
        rng = np.random.default_rng(2)
        at, first = self.windows(texts)
        many = np.diff(np.append(first, len(at)))
        m, s, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        m, s = tuple(m)
        toxic = np.flatnonzero(labels == 1)
        clean = np.flatnonzero(labels == 0)
        for _ in range(ROUNDS):
            self.inputs = self.inputs[:0]
            logits = self.logits(at)
            top = np.array([f + int(logits[f : f + n].argmax()) for f, n in zip(first, many, strict=True)])
            other = first[clean] + rng.integers(0, many[clean])
            rows = np.concatenate([top[toxic], top[clean], other])
            y = (np.arange(len(rows)) < len(toxic)).astype(np.float32)
            weight = np.where(y == 1, len(rows) / (2 * len(toxic)), len(rows) / (2 * (len(rows) - len(toxic))))
            for _ in range(EPOCHS):
                order = rng.permutation(len(rows))
                for k in range(0, len(order), BATCH):
                    part = order[k : k + BATCH]
                    step += 1
                    for name, g in self._gradients(at[rows[part]], y[part], weight[part]).items():
                        m[name] += 0.1 * (g - m[name])
                        s[name] += 0.001 * (g * g - s[name])
                        self.p[name] = (self.p[name] - RATE * m[name] / (1 - 0.9**step) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.inputs = self.inputs[:0]
        self._calibrate(np.maximum.reduceat(self.logits(at), first).astype(np.float64), labels)
        self._forget()
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """scale and shift by Newton's method, with a small penalty so that separable texts stay finite."""
        b = np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):
            p = _sigmoid(design @ b)
            h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
            move = np.linalg.solve(h, design.T @ (p - y) + 1e-2 * (b - [1.0, 0.0]))
            b = b - np.clip(move, -2, 2)
        self.scale, self.shift = max(float(b[0]), 1e-3), float(b[1])


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return np.full(len(texts), self.share)


def train(texts: list[str], labels: list[int]) -> Network | Constant:
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return Constant(float(y.mean()) if len(y) else 0.5)
    words = [words_of(t) for t in texts]
    seen, bad = Counter(), Counter()
    for w, label in zip(words, labels, strict=True):
        own = set(w)
        seen.update(own)
        if label:
            bad.update(own)
    kept = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1]
    share = y.mean()
    odds = np.zeros(len(kept) + 1, np.float32)
    for i, w in enumerate(kept, 1):
        p = (bad[w] + 3 * share) / (seen[w] + 3)
        odds[i] = np.clip(np.log(p / (1 - p)) - np.log(share / (1 - share)), -2, 4)
    return Network({w: i for i, w in enumerate(kept, 1)}, odds).fit(words, y)


def score(docs: DataFrame, labels: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    held_out: a condition on doc_id, the column of both tables; labels of such rows aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(1, SAMPLE_TOXIC).unionByName(by_hash(0, SAMPLE_CLEAN))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows, so this side is always small enough to be sent to the tasks.
    sample = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    shared = spark.sparkContext.broadcast(train([r.text for r in sample], [r.toxic for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(2)]
            out, at = [], 0
            while at < len(words):
                end, size = at + 1, len(words[at])
                while end < len(words) and size + len(words[end]) < 200_000:
                    size += len(words[end])
                    end += 1
                out.append(network.scores(words[at:end]))
                at = end
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels of documents whose crc32(doc_id as text) mod 5 isn't 0 and scores all documents."""
    return score(docs, labels, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
