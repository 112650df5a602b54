"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The automaton holds all test items, word by word. A document's words are streamed
through it and the longest match that ends at each word is tracked; where that is a
window or more long, the words of the window are hit. A window is WINDOW
consecutive words of an item; an item of fewer words, but not none, is one window.

Before streaming, numpy marks the words that start a gram of an item; a window can
only lie in a run of marked words, so only those runs are streamed. This leaves the
matches as they are and skips nearly all words.

Items are cut into groups of at most GROUP_BYTES of text, each with an automaton of flat
arrays. The packed automata go to every task, which opens one after another for a chunk of
documents and unites what they find, so one open automaton's memory is all that a task
needs; beyond SENT bytes of them, what is found is written and further passes follow.

Defined results: null or wordless texts and items have no windows; repeated items
count once for each distinct item_id; an item without an id hits words but is neither counted
nor named; repeated documents, and those without an id, are rows of their own. Columns of the
input that clash with n_words, spans or items give way, in remove() none does. Empty tables
give an empty result or no hits.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import lean, small_batches, text_or_empty, written

WINDOW = 10
GRAM = 3
#: Text of the items in one automaton, text of documents that pass an open one, bytes of packed automata that are sent.
GROUP_BYTES, CHUNK, SENT = 4 << 20, 8 << 20, 128 << 20
#: What isn't a word's byte becomes a space, A-Z become a-z; UTF-8's other bytes belong to words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class SuffixAutomaton:
    """Of several word sequences. State 0 is the start; link and length are the usual ones.

    Most states have one next state, kept in two arrays; `more` holds the others' further ones. `whole` has, for some
    states, the (length, sequence) of those that are one of its strings entirely. The sequences that hold a state's
    strings of `window` words are items[first[state] : first[state + 1]], for states that have such strings.
    """

    def __init__(self, sequences: list[list[int]], window: int = WINDOW):
        self.word, self.to, self.more = array("i", [-1]), array("i", [0]), {}
        self.link, self.length, self.whole = array("i", [-1]), array("i", [0]), {}
        ends, owner = array("i"), array("i")
        for i, sequence in enumerate(sequences):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                ends.append(last)
                owner.append(i)
            if sequence:
                self.whole.setdefault(last, []).append((len(sequence), i))
        states, owners = np.array(ends, np.int64), np.array(owner, np.int64)
        length, link = np.array(self.length, np.int64), np.array(self.link, np.int64)
        some = length[states] >= window
        states, owners = states[some], owners[some]
        while len(up := np.flatnonzero(length[link[states]] >= window)):
            states[up] = link[states[up]]
        pairs = np.unique(states * max(1, len(sequences)) + owners)
        self.items = (pairs % max(1, len(sequences))).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, len(sequences)), np.arange(len(length) + 1)).astype(np.int32)

    def step(self, state: int, word: int) -> int:
        """The next state, or -1."""
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def _put(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _split(self, p: int, word: int, q: int) -> int:
        clone = len(self.link)
        self.word.append(self.word[q])
        self.to.append(self.to[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        own = self.whole.pop(q, [])
        for state, part in ((clone, [x for x in own if x[0] <= self.length[clone]]), (q, [x for x in own if x[0] > self.length[clone]])):
            if part:
                self.whole[state] = part
        while p >= 0 and self.step(p, word) == q:
            self._put(p, word, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.step(last, word)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = len(self.link), last
        self.word.append(-1)
        self.to.append(0)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and self.step(p, word) < 0:
            self._put(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """Of each word: its place, the state of the longest match that ends there, and that match's length."""
        state = matched = 0
        for at, word in enumerate(words):
            following = self.step(state, word)
            while state and following < 0:
                state = self.link[state]
                matched = self.length[state]
                following = self.step(state, word)
            if following >= 0:
                state, matched = following, matched + 1
            yield at, state, matched


class Matcher:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        items = [(i, w) for i, w in items if w]
        self.ids, self.window, self.vocabulary = [i for i, _ in items], window, {}
        for _, w in items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        sequences = [[self.vocabulary[x] for x in w] for _, w in items]
        self.automaton = SuffixAutomaton(sequences, window)
        self.short = [len(w) < window for _, w in items]
        self.least = min((min(len(s), window) for s in sequences), default=window)
        self.gram = min(GRAM, self.least)
        grams = [self._grams(np.array(s, np.int64)) for s in sequences]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each gram by its start."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(self.gram):
            h = (h ^ (ids[k : k + n] + 1).astype(np.uint64)) * _FOLD
            h ^= h >> np.uint64(29)
        return h * _FOLD

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(begin, end) of occurrences of windows, which may overlap, and the indices of their items."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.least or not self.ids:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        h = self._grams(ids)
        marked = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(marked)
        if not len(some):
            return spans, found
        at = np.searchsorted(self.grams, h[some])
        some = some[self.grams[np.minimum(at, len(self.grams) - 1)] == h[some]]
        seen: set[int] = set()
        for run in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1):
            if len(run) >= self.least - self.gram + 1:
                begin = int(run[0])
                self._stream(ids[begin : int(run[-1]) + self.gram].tolist(), begin, spans, found, seen)
        return spans, found

    def _stream(self, ids: list[int], begin: int, spans: list[tuple[int, int]], found: set[int], seen: set[int]) -> None:
        """seen: states whose items are in found already."""
        auto, window, short = self.automaton, self.window, self.short
        length, link, whole = auto.length, auto.link, auto.whole
        for at, state, matched in auto.stream(ids):
            if matched < self.least:
                continue
            end = begin + at + 1
            if matched >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                spans.append((end - window, end))
                if s not in seen:
                    seen.add(s)
                    found.update(auto.items[auto.first[s] : auto.first[s + 1]].tolist())
            s = state
            while s > 0:
                for n, i in whole.get(s, ()):
                    if short[i] and n <= matched:
                        spans.append((end - n, end))
                        found.add(i)
                s = link[s]


def united_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that overlapping or touching spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of bounded size; only one group is held at a time."""
    group, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("id"), text_or_empty().alias("text")).distinct().toLocalIterator():
        if size and size + len(row.text) > limit:
            yield group
            group, size = [], 0
        group.append((row.id, row.text))
        size += len(row.text)
    if group:
        yield group


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with n_words long, spans array<struct<begin, end>>: runs of words [begin, end) that windows cover, and items
    array<string>: the ids of the items that these windows are of, sorted."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    base = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items", "_text")]
    names = [f.name for f in base]  # clashing columns of the input give way
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [T.StructField("_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", kind), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*base, *added])
    arrow = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    out = docs.select(*names, text_or_empty().alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(kind).alias("spans"), F.array().cast("array<string>").alias("items"))
    k = len(names)

    def step(shared):
        def chunk(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [words_of(t) for b in batches for t in b.column(k).to_pylist()]
            spans = [[(s["begin"], s["end"]) for s in x] for b in batches for x in b.column(k + 2).to_pylist()]
            items = [set(x) for b in batches for x in b.column(k + 3).to_pylist()]
            for packed in shared.value:
                matcher = pickle.loads(zlib.decompress(packed))
                for words, own, names_ in zip(rows, spans, items, strict=True):
                    more, found = matcher.hits(words)
                    own += more
                    names_.update(matcher.ids[i] for i in found if matcher.ids[i] is not None)
                del matcher
            at = 0
            for b in batches:
                own = range(at, at + b.num_rows)
                at += b.num_rows
                runs = pa.array([[{"begin": x, "end": y} for x, y in united_runs(spans[i])] for i in own], arrow)
                sizes, found = pa.array([len(rows[i]) for i in own], pa.int64()), pa.array([sorted(items[i]) for i in own], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k + 1)), sizes, runs, found], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column(k).nbytes
                if size >= CHUNK:
                    yield from chunk(held)
                    held, size = [], 0
            if held:
                yield from chunk(held)
            lean()

        return run

    passes: list[list[bytes]] = [[]]
    for group in _groups(benchmark, group_bytes):
        packed = zlib.compress(pickle.dumps(Matcher([(i, words_of(t)) for i, t in group], window)), 1)
        if passes[-1] and sum(map(len, passes[-1])) + len(packed) > SENT:
            out = written(out.mapInArrow(step(context.broadcast(passes.pop())), schema), "matched")
            passes.append([])
        passes[-1].append(packed)
    return out.mapInArrow(step(context.broadcast(passes[-1])), schema).drop("_text")


def hit_words(spans: str = "spans"):
    """How many words the runs hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with an occurring window, and whether there are any."""
    out = match(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, most_words: int = 0, most_coverage: float = 0.0, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs without the matched spans: each run of hit words longer than most_words goes, with what stands between
    its words; a document whose hit words are more than most_coverage of its words loses all its runs.

    A run goes if either limit is exceeded. With the defaults every hit word goes.
    """
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).flatten()
            texts = own[at].to_pylist()
            for k, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    texts[k] = cut(texts[k], spans, most_words, most_coverage)
            own[at] = pa.array(texts, own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)
        lean()

    # The row travels as one struct, so no column of the input can clash with the spans.
    found = match(docs.select(F.struct(*columns).alias("_row"), "text"), benchmark, window, group_bytes)
    return found.select("_row", "spans").mapInArrow(run, schema)


def cut(text: str, spans: list[dict], most_words: int, most_coverage: float) -> str:
    raw = text.encode()
    plain = np.frombuffer(b" " + raw.translate(WORDS) + b" ", np.uint8) != 32
    edges = np.diff(plain.astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hit = np.zeros(len(begins) + 2, np.int8)
    for s in spans:
        hit[s["begin"] + 1 : s["end"] + 1] = 1
    step = np.diff(hit)
    runs = list(zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True))
    everything = hit.sum() > most_coverage * len(begins)
    out, last = [], 0
    for a, b in runs:
        if everything or b - a > most_words:
            out.append(raw[last : begins[a]])
            last = ends[b - 1]
    return b"".join([*out, raw[last:]]).decode()
