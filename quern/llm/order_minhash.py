"""Operator 6: near-duplicate documents by Order MinHash, verified by banded alignment.

Words are runs of letters, digits and non-ASCII characters with A-Z folded. A document's
k-mers are its runs of SHINGLE words, each labelled with how often it occurred
before. One repeat takes the PICK labelled k-mers of smallest hash and keeps their
order in the text; REPEATS of them are the sketch. Two documents meet where any
repeat agrees. What meets is verified: the similarity is 1 - d / max(words), d the
edit distance on words, and a link needs THRESHOLD or more, so the alignment never
leaves a band of (1 - THRESHOLD) * max(words) diagonals. Before texts are moved, a second
sketch of the words regardless of order drops pairs that share too few words.

1. Documents with equal words are one class from here on.
2. Classes meet in buckets (repeat and key) and are compared as near.py says: with leaders
   first, then every bucket in full.
3. Union-find over all verified links gives the groups; texts under one doc_id are one document.

Defined results: a text of 1 to SHINGLE - 1 words is one k-mer; null, empty and wordless
texts link with nothing; repeated rows and equal texts are one class; rows with the same
doc_id are one document if any of them links, each compared by its own text; rows without a
doc_id aren't compared, are groups of their own (class and group are null) and stay. Extra
columns are ignored or, in near_dedup, kept. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fingerprint, free_shuffles, lean, ragged, small_batches, text_or_empty, written
from quern.llm.components import components
from quern.llm.decontaminate import WORDS
from quern.llm.near import linked
from quern.llm.substrings import _TABLE, _power, _powers, mix

#: With so many repeats, a pair with a fifth of its words replaced at scattered places (similarity 0.8) meets in 9 of 10
#: cases, one with 15 % replaced in 99 of 100.
SHINGLE, PICK, REPEATS, THRESHOLD = 5, 2, 84, 0.8
BLOCK_WORDS = 1 << 17
#: Draws of the bag sketch. A similarity of 0.8 needs a Jaccard similarity of ALIKE or more on labelled words.
BAG, ALIKE = 64, 2 / 3
#: Pairs of texts whose words are hashed together.
PAIRS = 128
_FOLD = np.array(bytearray(WORDS), np.uint8)
_SEEDS = mix(np.arange(1, 2 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that lie one after another in flat, and the number of words of each text."""
    folded = _FOLD[flat]
    plain = np.zeros(len(flat) + 2, np.int8)
    plain[1:-1] = folded != 32
    edge = np.flatnonzero(np.diff(plain))
    cut = np.zeros(len(flat) + 1, bool)
    cut[starts] = True
    begins, ends = edge[::2], edge[1::2]
    if len(starts) > 1:  # words don't join over the edge of two texts
        inner = starts[1:][(starts[1:] > 0) & (starts[1:] < len(flat))]
        inner = np.unique(inner[(plain[inner] == 1) & (plain[inner + 1] == 1)])
        begins, ends = np.sort(np.concatenate([begins, inner])), np.sort(np.concatenate([ends, inner]))
    up, down = _power(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_TABLE[folded] * up[: len(flat)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins])
    counts = np.searchsorted(begins, starts + sizes) - np.searchsorted(begins, starts)
    return hashes, counts


def sketches(words: np.ndarray, counts: np.ndarray, repeats: int = REPEATS, pick: int = PICK, shingle: int = SHINGLE) -> np.ndarray:
    """The sketch of each text as a row of 64-bit keys; texts without words have rows that mean nothing."""
    n = len(counts)
    begins = np.cumsum(counts) - counts
    grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(n), grams)
    first = ragged(np.arange(len(words)), begins, grams)
    value = np.zeros(len(first), np.uint64)
    end = (begins + counts)[of]
    for k in range(shingle):
        at = first + k
        value = mix(value + np.where(at < end, words[np.minimum(at, len(words) - 1)], np.uint64(k + 1)))
    labelled = _labelled(value, of)
    out = np.zeros((n, repeats), np.uint64)
    some = np.flatnonzero(grams)
    if not len(some):
        return out
    edges = (np.cumsum(grams) - grams)[some]
    bits = np.uint64(max(1, len(value).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    index = np.arange(len(value), dtype=np.uint64)
    rank = np.empty(len(value), np.uint64)
    for r in range(repeats):
        np.bitwise_xor(labelled, _SEEDS[2 * r], out=rank)
        np.multiply(rank, _SEEDS[2 * r + 1] | np.uint64(1), out=rank)
        np.bitwise_and(rank, ~low, out=rank)
        np.bitwise_or(rank, index, out=rank)
        taken = []
        for _ in range(pick):
            least = np.minimum.reduceat(rank, edges)
            at = (least & low).astype(np.int64)
            gone = least == np.uint64(2**64 - 1)
            at[gone] = -1
            taken.append(at)
            rank[at[~gone]] = np.uint64(2**64 - 1)
        order = np.sort(np.stack(taken), 0)  # in the order of the text; what is missing comes first
        key = np.full(len(some), r + 1, np.uint64)
        for at in order:
            key = mix(key + np.where(at >= 0, labelled[np.maximum(at, 0)], np.uint64(0)))
        out[some, r] = key
    return out


def bags(words: np.ndarray, counts: np.ndarray, draws: int = BAG) -> np.ndarray:
    """A byte from 1 on for each draw: MinHash of each text's labelled words, the rest of its order left out."""
    n = len(counts)
    out = np.zeros((n, draws), np.int8)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    labelled = _labelled(words, np.repeat(np.arange(n), counts))
    edges = (np.cumsum(counts) - counts)[some]
    for r in range(draws):
        least = np.minimum.reduceat((labelled ^ _SEEDS[-1 - 2 * r]) * (_SEEDS[-2 - 2 * r] | np.uint64(1)), edges)
        out[some, r] = (mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8).view(np.int8)
    return out


def _labelled(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The values, those that occurred before in their text with their count mixed in."""
    pair = mix(value ^ mix(of.astype(np.uint64)))
    order = np.argsort(pair, kind="stable")
    again = pair[order][1:] == pair[order][:-1]
    if not again.any():
        return value
    run = np.arange(len(value))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), run, 0))
    count = np.zeros(len(value), np.uint64)
    count[order] = (run - start).astype(np.uint64)
    return np.where(count > 0, mix(value + mix(count)), value)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences if it is at most `most`, else most + 1.

    Common ends and pairs with too few common elements are settled first. The band is
    narrow to begin with and widened if the distance doesn't fit.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    same = min(n, m)
    unequal = np.flatnonzero(a[:same] != b[:same])
    head = int(unequal[0]) if len(unequal) else same
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    same = min(n, m)
    unequal = np.flatnonzero(a[n - same :][::-1] != b[m - same :][::-1])
    tail = int(unequal[0]) if len(unequal) else same
    a, b = a[: n - tail], b[: m - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else most + 1
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if max(n, m) - int(np.minimum(cx[i], cy[j]).sum()) > most:
        return most + 1
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    other = b.tolist()
    band = max(16, abs(n - m))
    while True:
        band = min(band, most)
        found = _in_band(at, n, other, band)
        if found <= band or band == most:
            return min(found, most + 1)
        band *= 8


def _in_band(at: dict[int, int], n: int, other: list[int], band: int) -> int:
    """Bit-parallel dynamic programming over the cells with |row - column| <= band.

    The bits of an integer are the vertical differences of one column's cells in the
    band; its top bit is row column + band until the last row is reached, which then
    moves down by a bit a column. Over `band`, the result only says so.
    """
    width = min(band, n)
    size = band + width + 1
    mask, top = (1 << size) - 1, 1 << (size - 1)
    rise, fall, score = mask & ~((1 << (size - width - 1)) - 1), 0, width
    last, shift = top >> 1, width + 1 - size
    turn = n - width
    get = at.get
    for column, x in enumerate(other):
        where = get(x, 0)
        if where:
            where = (where >> shift if shift > 0 else where << -shift) & mask
        shift += 1
        flat = ((((where & rise) + rise) ^ rise) | where | fall) & mask
        right = fall | (mask & ~(flat | rise))
        left = flat & rise
        if column < turn:
            if not flat & top:
                score += 1
                if score > 3 * band + 1:
                    return band + 1
        else:
            if right & last:
                score += 1
            elif left & last:
                score -= 1
            last >>= 1
        flat >>= 1
        rise = left | (mask & ~(flat | right))
        fall = flat & right
    return score


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    return longest > 0 and banded_distance(a, b, most) <= most


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def _elements(threshold: float):
    """For the comparison in full (near.py): labelled words, as texts share at least what an alignment keeps."""

    def of(texts: pa.Array):
        words, counts = word_hashes(*_flat(texts))
        each = np.split(words, np.cumsum(counts)[:-1])
        longest_less = lambda longest: longest - ((1 - threshold) * longest + 1e-9).astype(np.int64)
        _powers.clear()
        return _labelled(words, np.repeat(np.arange(len(counts)), counts)), counts, lambda n, m: longest_less(np.maximum(n, m)), lambda i, j: similar(each[i], each[j], threshold)

    return of


_KEYS = "doc_id long, th long, h1 long, h2 long, n_words int, keys array<long>, bag array<tinyint>"
_KEYS_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int32()), ("keys", pa.list_(pa.int64())), ("bag", pa.list_(pa.int8()))])


def _sketch_task(repeats: int, pick: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begins, sizes = _flat(batch.column(2))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(begins, begins[at] + (BLOCK_WORDS << 2))))
                a, b = begins[at], begins[end - 1] + sizes[end - 1]
                words, counts = word_hashes(flat[a:b], begins[at:end] - a, sizes[at:end])
                keys = sketches(words, counts, repeats, pick, shingle).view(np.int64)
                first = np.cumsum(counts) - counts
                place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
                both = []
                for salt in (3, 5):
                    sums = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(mix(words + mix(place * np.uint64(2) + np.uint64(salt))), out=sums[1:])
                    both.append(mix(sums[first + counts] - sums[first]).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, keys.shape[1], 0))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].ravel()))]
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BAG, 0))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(bags(words, counts)[counts > 0].ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(both[0]), pa.array(both[1]), pa.array(counts.astype(np.int32)), *lists], schema=_KEYS_ARROW)
                at = end
        _powers.clear()
        lean()

    return run


def _verify_task(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PAIRS) for whole in batches for i in range(0, whole.num_rows, PAIRS)):
            sides = []
            for k in (2, 3):
                words, counts = word_hashes(*_flat(batch.column(k)))
                sides.append(np.split(words, np.cumsum(counts)[:-1]))
            keep = pa.array([similar(x, y, threshold) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)
        _powers.clear()
        lean()

    return run


def groups(docs: DataFrame, threshold: float = THRESHOLD, repeats: int = REPEATS, pick: int = PICK, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), group_id (smallest reachable over links), n_words.

    A row for each distinct pair of a doc_id and its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(text_or_empty(text)).alias("_th"), text_or_empty(text).alias("_text"))
    made = written(own.mapInArrow(_sketch_task(repeats, pick, shingle), _KEYS), "sketches")
    # Of each class, one row of the smallest doc_id: _th tells texts under one doc_id apart.
    least = F.struct(F.col("doc_id").alias("doc"), "th", "keys", "bag", "n_words")
    classes = made.filter("n_words > 0").groupBy("h1", "h2").agg(F.min(least).alias("c")).select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "c.*")
    classes = written(classes, "classes")
    rows = classes.select("id", F.explode("keys").alias("key"))  # a key holds its repeat
    met = written(rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"), "met")
    some = classes.join(met.select("id").distinct(), "id", "left_semi")
    texts = written(own.join(some.select("id", "doc", "th"), (F.col("_doc") == F.col("doc")) & (F.col("_th") == F.col("th"))).dropDuplicates(["id"]).select("id", "_text"), "texts")
    marks = written(some.select("id", F.col("n_words").alias("n"), "bag"), "marks")
    free_shuffles(spark)
    parts = linked(met, marks, texts, _verify_task(threshold), _elements(threshold), threshold, ALIKE)
    same = made.join(classes.select("h1", "h2", F.col("id").alias("class"), F.col("doc").alias("class_id")), ["h1", "h2"]).filter("n_words > 0").select("doc_id", "class", "class_id", "n_words").distinct()
    # Different texts under one doc_id: their classes are linked through it.
    several = written(same.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.collect_set("class").alias("all")).filter("a < z").select("a", F.explode("all").alias("b")), "several")
    if several.limit(1).count():
        links = several.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
        parts = written(components(links, "a", "b"), "parts")
    placed = same.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_class = placed.groupBy("class", "component").agg(F.min("class_id").alias("doc"))
    of_group = of_class.groupBy("component").agg(F.min("doc").alias("group_id"))
    found = placed.join(of_class.join(of_group, "component").select("class", "group_id"), "class")
    lone = made.filter("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), "n_words").distinct()
    return found.select("doc_id", "class_id", "group_id", "n_words").unionByName(lone)


def near_dedup(docs: DataFrame, **options: object) -> DataFrame:
    """docs without all but the smallest doc_id of each group of near-duplicates; rows keep their columns.

    Of rows that are equal in doc_id and words, one stays. Rows without a doc_id aren't compared and all stay.
    """
    found = groups(docs, **options).groupBy("doc_id").agg(F.min("group_id").alias("_group"))
    drop = found.filter("doc_id != _group").select(F.col("doc_id").alias("_gone"))
    left = docs.join(drop, docs["doc_id"] == drop["_gone"], "left_anti")
    words = F.trim(F.regexp_replace(F.translate(text_or_empty(), string.ascii_uppercase, string.ascii_lowercase), r"[\x00-\x7F&&[^a-z0-9]]+", " "))
    words = F.when(words == "", text_or_empty()).otherwise(words)
    marks = {"_h1": fingerprint(words, 1), "_h2": fingerprint(words, 2), "_row": F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())}
    return left.withColumns(marks).dropDuplicates(["doc_id", *marks]).drop(*marks)


def report(docs: DataFrame) -> DataFrame:
    """Per document: its class of equal words, its group, and whether it is the one that stays; rows without a doc_id stay."""
    found = groups(docs.select("doc_id", "text"))
    found = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id")).withColumn("kept", F.col("doc_id") == F.col("group_id"))
    none = F.lit(None).cast("long")
    return found.unionByName(docs.filter("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("group_id"), F.lit(True).alias("kept")))
