"""Operator 3: scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are words (A-Z lower-cased, cut at white space) and one end for each text. The
model predicts a token's class from the two classes before it, and the token within
its class by the counts:

    p(w | u, v) = p(class of w | class of u, class of v) * p(w | class of w)

The SINGLES most frequent words are classes of their own; any other word's class follows
from its last two bytes. Classes: at most CLASSES. The class model is log-bilinear:
score(c | a, b) = r_c . (C1 r_a + C2 r_b) + bias_c, normalised over all classes. In a
class of several words a word not seen in training has the share that words seen once had.

1. Word counts over all training texts: partial sums by task, sharded by word.
2. Training: a start on at most WARM_TOKENS tokens, then every task trains on all of its
   texts from that start, and the weights are averaged by tokens, in a tree. So all
   training texts are learnt from, and the driver gets a few models of fixed size.
3. Normalisers of all pairs of classes by batched matrix products, once.
4. Scoring: three table look-ups a token. Counts of the HEAD most frequent words go
   to every task; all other words' counts are joined by word. With no more than HEAD
   distinct words there is nothing to join.

Defined results: null is an empty text, which is its end; null doc_ids count as the
empty text's crc32; repeated rows are texts of their own; with no training texts at all,
probabilities come from an untrained model and counts of 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, text_or_empty, written

CLASSES, SINGLES, HEAD, DIM = 768, 384, 150_000, 32
WARM_TOKENS, BATCH, NOISE, RATE = 400_000, 2048, 64, 0.15
END = 0
#: Distinct words that a counting task holds before it passes them on.
HELD = 400_000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["w", "c"])

    for batch in batches:
        for text in batch.column(0):
            held.update(words_of(text.as_py()))
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


class Vocabulary:
    """The head's counts, and every word's class."""

    def __init__(self, head: list[tuple[str, int]], suffixes: list[str], total: int, distinct: int, ends: int):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.complete = distinct <= len(head)
        self.words = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        singles = min(SINGLES, len(head))
        self.suffix = {s.encode("latin-1"): 1 + singles + i for i, s in enumerate(suffixes)}
        self.other = 1 + singles + len(suffixes)
        self.size, self.singles = self.other + 1, singles
        self.of = np.array([1 + i if i < singles else self.class_of(w.encode()) for i, (w, _) in enumerate(head)], np.int32)

    def class_of(self, word: bytes) -> int:
        """Of a word that is no single."""
        return self.suffix.get(word[-2:], self.other)

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head (-1: not there) and class of each word."""
        at = np.fromiter(map(self.words.get, words, [-1] * len(words)), np.int64, len(words))
        out = self.of[at] if len(self.of) else np.zeros(len(at), np.int32)
        for k in np.flatnonzero(at < 0).tolist():
            out[k] = self.class_of(words[k])
        return at, out


class Model:
    """r: class vectors of contexts; t: of targets; c1, c2: of the two places; b: biases."""

    names = ("r", "t", "c1", "c2", "b")

    def __init__(self, size: int, prior: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r, self.t = (rng.normal(0, 0.3, (size, DIM)).astype(np.float32) for _ in range(2))
        self.c1, self.c2 = np.eye(DIM, dtype=np.float32), np.eye(DIM, dtype=np.float32)
        self.prior = prior.astype(np.float32)
        self.b = np.log(self.prior)
        self.squares = {n: np.full_like(getattr(self, n), 0.1) for n in self.names}

    def learn(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation: a, b are the classes before c (a is the nearer one)."""
        n = len(c)
        noise = np.searchsorted(np.cumsum(self.prior), rng.random(NOISE)).clip(0, len(self.prior) - 1)
        ra, rb = self.r[a], self.r[b]
        q = ra @ self.c1 + rb @ self.c2
        tc, tn = self.t[c], self.t[noise]
        # The noise is drawn from the prior, NOISE times; the model is taken as normalised, as usual.
        k = math.log(NOISE)
        own = np.einsum("nd,nd->n", q, tc) + self.b[c] - np.log(self.prior[c]) - k
        other = q @ tn.T + self.b[noise] - np.log(self.prior[noise]) - k
        e = -1 / (1 + np.exp(np.clip(own, -30, 30)))
        f = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
        dq = e[:, None] * tc + f @ tn
        dt = _scatter(c, e[:, None] * q, len(self.b)) + _scatter(noise, f.T @ q, len(self.b))
        db = np.bincount(c, e, len(self.b)) + np.bincount(noise, f.sum(0), len(self.b))
        dr = _scatter(a, dq @ self.c1.T, len(self.b)) + _scatter(b, dq @ self.c2.T, len(self.b))
        for name, g in (("r", dr), ("t", dt), ("c1", ra.T @ dq), ("c2", rb.T @ dq), ("b", db)):
            g = (g / n).astype(np.float32) if name in ("c1", "c2") else (g / 32).astype(np.float32)
            s = self.squares[name]
            s += g * g
            setattr(self, name, getattr(self, name) - RATE * g / np.sqrt(s))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names]).astype(np.float32)

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for n in self.names:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by nearer class and class (with bias), by farther class and class, and log normalisers of pairs."""
        near = (self.r @ self.c1) @ self.t.T + self.b
        far = (self.r @ self.c2) @ self.t.T
        normal = np.empty((len(self.b), len(self.b)), np.float32)
        for a in range(len(self.b)):
            x = near[a] + far
            top = x.max(1, keepdims=True)
            normal[a] = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
        return near, far, normal


def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by index."""
    flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, rows.ravel(), size * DIM).reshape(size, DIM)


def sequences(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all texts: head index (-2: an end) and class of each token, tokens per text, and the words without ends."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(s) + 1 for s in split], np.int64)
    words = [w for s in split for w in s]
    at, cls = np.full(int(sizes.sum()), -2, np.int64), np.full(int(sizes.sum()), END, np.int32)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(sizes) - 1] = False
    at[inside], cls[inside] = vocabulary.classes(words)
    return at, cls, sizes, words


def contexts(cls: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; before a text there are ends."""
    begin = np.cumsum(sizes) - sizes
    a, b = np.full(len(cls), END, np.int32), np.full(len(cls), END, np.int32)
    a[1:], b[2:] = cls[:-1], cls[:-2]
    a[begin] = END
    b[begin] = END
    second = begin + 1
    b[second[second < len(b)]] = END
    return a, b


def _train(model: Model, cls: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> None:
    a, b = contexts(cls, sizes)
    order = rng.permutation(len(cls))
    for k in range(0, len(order), BATCH):
        part = order[k : k + BATCH]
        model.learn(a[part], b[part], cls[part], rng)


def _blocks(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def fit(texts: DataFrame) -> tuple[Vocabulary, Model, DataFrame]:
    """texts: the training texts (text string, not null). The last result is all word counts (w, c)."""
    spark = texts.sparkSession
    small_batches(spark)
    counts = written(texts.mapInArrow(_count_task, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = texts.count()
    head = [(r.w, r.c) for r in counts.orderBy(F.desc("c"), "w").limit(HEAD).toLocalIterator()]
    raw = F.expr("right(hex(w), 4)")
    rest = counts.join(F.broadcast(spark.createDataFrame([(w,) for w, _ in head[:SINGLES]], "w string")), "w", "left_anti")
    by_suffix = rest.groupBy(raw.alias("s")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once"))
    suffixes = by_suffix.orderBy(F.desc("n"), "s").limit(CLASSES - 2 - min(SINGLES, len(head))).collect()
    vocabulary = Vocabulary(head, [bytes.fromhex(r.s).decode("latin-1") for r in suffixes], seen.n + ends, seen.v + (ends > 0), ends)
    vocabulary.complete = seen.v <= len(head)
    totals = np.zeros(vocabulary.size)
    totals[END] = ends
    totals[1 : 1 + vocabulary.singles] = vocabulary.counts[: vocabulary.singles]
    once = np.zeros(vocabulary.size)
    for r in suffixes:
        k = vocabulary.suffix[bytes.fromhex(r.s)]
        totals[k], once[k] = r.n, r.once
    all_rest = by_suffix.agg(F.sum("n"), F.sum("once")).first()
    totals[vocabulary.other] = max(0, (all_rest[0] or 0) - sum(r.n for r in suffixes))
    once[vocabulary.other] = max(0, (all_rest[1] or 0) - sum(r.once for r in suffixes))
    vocabulary.class_totals = totals
    new = (once + 1) / (totals + once + 1)
    new[: 1 + vocabulary.singles] = 0
    vocabulary.new = new
    model = Model(vocabulary.size, (totals + 1) / (totals.sum() + len(totals)))
    sample, size = [], 0
    for r in texts.select("text").limit(WARM_TOKENS // 20).toLocalIterator():
        sample.append(r.text)
        size += len(r.text)
        if size > 6 * WARM_TOKENS:
            break
    rng = np.random.default_rng(3)
    if sample:
        for _ in range(2):
            _, cls, sizes, _ = sequences(sample, vocabulary)
            _train(model, cls, sizes, rng)
    start = model.flat()
    model = _average(texts, vocabulary, model, start)
    return vocabulary, model, counts


def _average(texts: DataFrame, vocabulary: Vocabulary, model: Model, start: np.ndarray) -> Model:
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = shared.value
        own, rng, tokens = None, np.random.default_rng(11), 0
        for batch in batches:
            if own is None:
                own = Model(known.size, first.prior).load(first.flat())
                own.squares = {n: s.copy() for n, s in first.squares.items()}
            for block in _blocks(batch.column(0).to_pylist(), 1 << 22):
                _, cls, sizes, _ = sequences(block, known)
                _train(own, cls, sizes, rng)
                tokens += len(cls)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(own.flat() * np.float64(tokens)).astype(np.float64).tobytes()], pa.binary())], names=["n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(w.as_py(), np.float64)
                n, total = n + k, x.copy() if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

    made = written(texts.select("text").mapInArrow(train, "n long, w binary"), "models")
    count = made.count()
    while count > 16:  # a tree of sums, so that the driver gets a few models whatever the number of tasks
        made = written(made.repartition(max(1, math.isqrt(count))).mapInArrow(add, "n long, w binary"), "models")
        count = made.count()
    rows = made.collect()
    if not rows:
        return model
    weights = sum(np.frombuffer(r.w, np.float64) for r in rows) / sum(r.n for r in rows)
    out = Model(vocabulary.size, model.prior).load(weights)
    out.squares = {}
    return out


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (near, far, normal) = shared.value
        base_of = lambda c: np.log10((c + 0.1) / (vocabulary.total + 0.1 * (vocabulary.distinct + 1)))
        base_head, base_end, base_new = base_of(vocabulary.counts), float(base_of(vocabulary.ends)), float(base_of(0))
        totals, new = np.maximum(vocabulary.class_totals, 1), vocabulary.new
        share = np.log10(np.maximum(1 - new, 1e-12)) - np.log10(totals)  # and log10 of the word's count, if it was seen
        with np.errstate(divide="ignore"):
            unseen = np.log10(new)
        in_head = share[vocabulary.of] + np.log10(vocabulary.counts) if len(vocabulary.of) else np.zeros(0)
        in_head[: vocabulary.singles] = 0.0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            done = 0
            for block in _blocks(texts):
                at, cls, sizes, words = sequences(block, vocabulary)
                a, b = contexts(cls, sizes)
                score = (near[a, cls] + far[b, cls] - normal[a, b]).astype(np.float64) / math.log(10)
                base = np.full(len(at), base_end)
                head, lost = at >= 0, at == -1
                score[head] += in_head[at[head]]
                base[head] = base_head[at[head]]
                known = head | ((at == -2) & (vocabulary.ends > 0))
                tails: list[list[dict]] = [[] for _ in block]
                if vocabulary.complete:
                    score[lost] += unseen[cls[lost]]
                    base[lost] = base_new
                else:
                    base[lost] = 0.0
                    text = np.repeat(np.arange(len(block)), sizes)
                    place = np.flatnonzero(lost)
                    for (i, w), n in Counter((int(text[p]), words[p - int(text[p])]) for p in place.tolist()).items():
                        k = vocabulary.class_of(w)
                        tails[i].append({"w": w.decode(), "n": n, "seen": float(share[k]), "unseen": float(unseen[k])})
                ends = np.cumsum(sizes) - sizes
                columns = [pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), ends)), pa.array(np.add.reduceat(base, ends)), pa.array(np.add.reduceat(score, ends)), pa.array(tails, _TAIL)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(block)), batch.column(1).slice(done, len(block)), *columns], names=_NAMES)
                done += len(block)

    return run


_TAIL = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32()), ("seen", pa.float64()), ("unseen", pa.float64())]))
_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"]


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    training: a condition on docs' columns; the rows for which it holds are learnt from.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~training).alias("held_out"), text_or_empty(text).alias("text"))
    vocabulary, model, counts = fit(own.filter(~F.col("held_out")).select("text"))
    shared = spark.sparkContext.broadcast((vocabulary, model.tables()))
    tail = "array<struct<w:string,n:int,seen:double,unseen:double>>"
    made = own.mapInArrow(_score_task(shared), f"doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail {tail}")
    names = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score"]
    if vocabulary.complete:
        return made.select(*names)
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = made.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts, "w", "left")
    c = F.coalesce("c", F.lit(0))
    n = F.col("n")
    rare = rare.select("row", F.when(c > 0, n).otherwise(0).alias("k"), (n * F.log10((c + 0.1) / (vocabulary.total + 0.1 * (vocabulary.distinct + 1)))).alias("b"), (n * F.when(c > 0, F.col("seen") + F.log10(F.greatest(c, F.lit(1)))).otherwise(F.col("unseen"))).alias("s"))
    rare = rare.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    out = made.drop("tail").join(rare, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), names[4], plus("base_score", "b"), plus("score", "s"))


def digest(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod 10 isn't 0 and scores all."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return score(docs, remainder != 0)
