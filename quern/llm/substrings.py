"""Operator 9: removal of repeated byte strings by prefix-free parsing.

Every LENGTH-byte string has one trigger: the place of the smallest rolling hash of
GRAM bytes in it, the leftmost of equal ones. The strings that share a trigger are
neighbours; together they are a phrase. Neighbouring phrases overlap by LENGTH - 1
bytes, so each LENGTH-byte string lies in exactly one phrase, at a place that only its
own bytes decide: equal strings have equal trigger grams and equal offsets to them.

1. Parse. Each task parses its texts into (trigger hash, phrase hash, document,
   place). Of equal phrases only those of the smallest document leave the task; the
   others are repeats already. So a passage in a third of all documents costs one
   record a task.
2. Dictionary. Records meet by trigger hash. A phrase that a smaller document also
   has is a repeat as a whole. If different phrases have one trigger gram, some of
   their strings may be equal: they go on as mixed phrases, with their bytes.
3. Suffix array of the mixed dictionary, for each group of triggers: all suffixes
   of LENGTH bytes or more, sorted by their first LENGTH bytes; neighbours with a
   common prefix of LENGTH are equal strings, and their smallest document decides.
4. The parse places the repeats in the documents, which drop the covered bytes.

Phrases and triggers are ordered by 64-bit fingerprints, not by their bytes, in step
2; a phrase counts as equal if both its trigger's and its own fingerprint agree.
Everything moves as packed arrays in buckets whose number follows the total bytes.

Defined results: null is empty; texts under LENGTH bytes lose nothing; rows with one
doc_id are one document for the comparison, and a row each in the result; a null doc_id
compares as the largest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_shuffles, ragged, small_batches, text_or_empty, written

LENGTH = 50
GRAM = 24
#: Bytes that are parsed together, bytes of text after which a task sends what it has, and bytes of a bucket.
BLOCK, FLUSH, BUCKET = 1 << 21, 20 << 20, 4 << 20
#: Suffixes that are sorted together.
SUFFIXES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = max(BLOCK, 1 << max(0, n - 1).bit_length()) + 64
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                out[done : 2 * done] = out[: min(done, size - done)] * step
                done *= 2
            both.append(out)
        _powers[size] = both[0], both[1]
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def parse(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Phrases of texts that lie one after another in flat.

    Arrays by phrase: text index, first string's place in flat, number of strings, trigger hash, phrase hash.
    """
    width, n = length - gram + 1, len(flat)
    counts = np.maximum(sizes - length + 1, 0)
    at = ragged(np.arange(n), starts, counts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[flat] * up[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(max(1, n.bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    trigger = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    of = np.repeat(np.arange(len(starts)), counts)
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (of[1:] != of[:-1])]))
    first, many = at[new], np.diff(np.concatenate([new, [len(at)]]))
    whole = mix((sums[first + many - 1 + length] - sums[first]) * down[first] + many.astype(np.uint64) * _MIX)
    # Where in the phrase the trigger stands is part of what the phrase is.
    whole = mix(whole + (trigger[new] - first).astype(np.uint64))
    return of[new], first, many, mix(hashes[trigger[new]] ^ np.uint64(0x5851F42D4C957F2D)), whole


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_KINDS = {
    "phrase": (np.uint64, np.uint64, np.int64, np.uint32, np.uint8),  # trigger, phrase, doc, place, strings
    "whole": (np.int64, np.uint32, np.uint8),  # doc, place, strings
    "mixed": (np.int64, np.uint32, np.uint8, np.uint64),  # doc, place, strings, trigger
    "bytes": (np.int64, np.uint32, np.uint8, np.uint64),  # the same, and the bytes after them
    "string": (np.int64, np.uint32, np.uint8),  # doc, place, 1
}


def _unpack(kind: str, blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _KINDS[kind]]
    size = sum(np.dtype(t).itemsize for t in _KINDS[kind])
    for blob in blobs:
        n, at = len(blob) // size, 0
        for part, t in zip(parts, _KINDS[kind], strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, _KINDS[kind], strict=True)]


def _deal(kind: str, bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, str, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), kind, _pack(*(a[part] for a in arrays))


_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash64(x: np.ndarray) -> np.ndarray:
    """As the SQL function of one long column, so that both sides of a join find the same bucket."""
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    h = np.uint64(50) + _XX[4] ^ turn(x.astype(np.uint64) * _XX[1], 31) * _XX[0]
    h = turn(h, 27) * _XX[0] + _XX[3]
    h = (h ^ (h >> np.uint64(33))) * _XX[1]
    h = (h ^ (h >> np.uint64(29))) * _XX[2]
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return xxhash64(doc) % buckets


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _smallest(doc: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group."""
    return np.repeat(np.minimum.reduceat(doc, begins), np.diff(np.concatenate([begins, [len(doc)]])))


_BLOBS = "bucket long, kind string, data binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


_NULL_ID = 2**63 - 1


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes without a copy, and each text's begin and size."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def _parse_task(buckets: int, length: int):
    """Step 1. Keys below buckets are triggers' buckets; those from buckets on are documents' buckets."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        trigger, phrase, doc, place, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, phrase, trigger))
        trigger, phrase, doc, place, many = (x[order] for x in (trigger, phrase, doc, place, many))
        again = doc > _smallest(doc, _groups(trigger, phrase))
        done = [doc[again], place[again], many[again]]
        rows = list(_deal("whole", buckets + _doc_bucket(done[0], buckets), done))
        kept = [x[~again] for x in (trigger, phrase, doc, place, many)]
        rows += _deal("phrase", (kept[0] % np.uint64(buckets)).astype(np.int64), kept)
        for k in range(0, len(rows), 256):
            yield _rows(rows[k : k + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            flat, begins, sizes = _flat(batch.column(1))
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy()
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(begins, begins[at] + BLOCK)))
                a, b = begins[at], begins[end - 1] + sizes[end - 1]
                of, first, many, trigger, phrase = parse(flat[a:b], begins[at:end] - a, sizes[at:end], length)
                if len(of):
                    place = first - (begins[at:end] - a)[of]
                    held.append([trigger, phrase, ids[at:end][of], place.astype(np.uint32), many.astype(np.uint8)])
                size += int(b - a)
                at = end
                if size >= FLUSH and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _dictionary(buckets: int):
    """Step 2, for one bucket of triggers; what already lies in a document's bucket passes."""

    def run(key, table):
        if key[0].as_py() >= buckets:
            return table
        trigger, phrase, doc, place, many = _unpack("phrase", table.column("data").to_pylist())
        order = np.lexsort((doc, phrase, trigger))
        trigger, phrase, doc, place, many = (x[order] for x in (trigger, phrase, doc, place, many))
        again = doc > _smallest(doc, _groups(trigger, phrase))
        rows = list(_deal("whole", buckets + _doc_bucket(doc[again], buckets), [doc[again], place[again], many[again]]))
        trigger, doc, place, many, phrase = (x[~again] for x in (trigger, doc, place, many, phrase))
        begins = _groups(trigger)
        mixed = _smallest(doc, begins) < -_smallest(-doc, begins) if len(doc) else np.zeros(0, bool)
        part = [doc[mixed], place[mixed], many[mixed], trigger[mixed]]
        rows += _deal("mixed", buckets + _doc_bucket(part[0], buckets), part)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _fetch_bytes(buckets: int, length: int):
    """The mixed phrases' bytes, dealt by trigger."""

    def run(key, docs, blobs):
        doc, place, many, trigger = _unpack("mixed", blobs.column("data").to_pylist())
        rows = []
        if len(doc) and docs.num_rows:
            docs = docs.combine_chunks()
            flat, begins, sizes = _flat(docs.column("_text").chunk(0))
            ids = docs.column("_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            # Rows with one id: a phrase stands in the row whose bytes at its place hold it, so all of them offer theirs.
            low, high = np.searchsorted(ids[order], doc), np.searchsorted(ids[order], doc, side="right")
            pick = np.repeat(np.arange(len(doc)), high - low)
            row = order[ragged(np.arange(len(ids)), low, high - low)]
            size = many[pick].astype(np.int64) + length - 1
            fits = place[pick].astype(np.int64) + size <= sizes[row]
            pick, row, size = pick[fits], row[fits], size[fits]
            data = [doc[pick], place[pick], many[pick], trigger[pick]]
            start = begins[row] + data[1].astype(np.int64)
            bucket = (data[3] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                head = _pack(*(a[part] for a in data))
                rows.append((int(bucket[part[0]]), "bytes", np.int64(len(part)).tobytes() + head + ragged(flat, start[part], size[part]).tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _suffix_array(buckets: int, length: int):
    """Step 3, for one bucket of triggers."""

    def run(key, table):
        heads, bodies = [], []
        for blob in table.column("data").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            size = n * sum(np.dtype(t).itemsize for t in _KINDS["bytes"])
            heads.append(blob[8 : 8 + size])
            bodies.append(np.frombuffer(blob, np.uint8, -1, 8 + size))
        doc, place, many, trigger = _unpack("bytes", heads)
        flat = np.concatenate(bodies) if bodies else np.zeros(0, np.uint8)
        sizes = many.astype(np.int64) + length - 1
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(trigger, kind="stable")
        rows, at = [], 0
        edge = np.concatenate([_groups(trigger[order]), [len(order)]]) if len(order) else np.zeros(1, np.int64)
        strings = np.concatenate([[0], np.cumsum(many[order].astype(np.int64))])
        while at < len(edge) - 1:
            end = max(at + 1, int(np.searchsorted(strings[edge], strings[edge[at]] + SUFFIXES, side="right")) - 1)
            part = order[edge[at] : edge[end]]
            at = end
            count = many[part].astype(np.int64)
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(begins[part], count) + shift
            of = np.repeat(doc[part], count)
            suffix = np.lib.stride_tricks.sliding_window_view(flat, length)[start].reshape(-1).view(f"S{length}")
            rank = np.argsort(suffix, kind="stable")
            same = _smallest(of[rank], _groups(suffix[rank]))
            again = np.zeros(len(of), bool)
            again[rank] = of[rank] > same
            where = (np.repeat(place[part].astype(np.int64), count) + shift)[again].astype(np.uint32)
            rows += _deal("string", buckets + _doc_bucket(of[again], buckets), [of[again], where, np.ones(len(where), np.uint8)])
        return pa.Table.from_batches([_rows(rows)])

    return run


def _covered(length: int):
    """Step 4: the rows of a document's bucket with the covered bytes as begin and end lists."""

    def run(key, docs, blobs):
        doc, place, many = (np.concatenate(x) for x in zip(*(_unpack(k, [d for d, kind in zip(blobs.column("data").to_pylist(), blobs.column("kind").to_pylist(), strict=True) if kind == k]) for k in ("whole", "string")), strict=True))
        order = np.argsort(doc, kind="stable")
        doc, place, size = doc[order], place[order].astype(np.int64), many[order].astype(np.int64) + length - 1
        texts, ids = docs.column("_text").to_pylist(), docs.column("_id").to_pylist()
        out: list[list] = [[], [], [], []]
        for i, text in zip(ids, texts, strict=True):
            raw = text.encode()
            a, b = np.searchsorted(doc, i), np.searchsorted(doc, i, side="right")
            step = np.zeros(len(raw) + 1, np.int32)
            begin = place[a:b]
            np.add.at(step, begin[begin < len(raw)], 1)
            np.add.at(step, np.minimum(begin + size[a:b], len(raw))[begin < len(raw)], -1)
            gone = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
            edge = np.flatnonzero(gone[1:] != gone[:-1])
            out[0].append(None if i == _NULL_ID else i)
            out[1].append(len(raw))
            out[2].append(edge.reshape(-1, 2).tolist())
            out[3].append(np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes())
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed array<[begin, end)>, kept binary: a row for each row of docs."""
    if not GRAM < length <= 255:
        raise ValueError(f"length must be between {GRAM + 1} and 255")
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("_id"), text_or_empty(text).alias("_text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-total // min(max(BUCKET, total // 20_000), 16 * BUCKET)))
    parsed = own.mapInArrow(_parse_task(buckets, length), _BLOBS)
    found = written(parsed.groupBy("bucket").applyInArrow(_dictionary(buckets), _BLOBS), "dictionary")
    free_shuffles(spark)
    by_doc = own.withColumn("bucket", buckets + F.pmod(F.xxhash64("_id"), F.lit(buckets))).groupBy("bucket")
    asked = by_doc.cogroup(found.filter("kind = 'mixed'").groupBy("bucket")).applyInArrow(_fetch_bytes(buckets, length), _BLOBS)
    strings = written(asked.groupBy("bucket").applyInArrow(_suffix_array(buckets, length), _BLOBS), "strings")
    free_shuffles(spark)
    every = found.filter("kind = 'whole'").unionByName(strings)
    return by_doc.cogroup(every.groupBy("bucket")).applyInArrow(_covered(length), "doc_id long, n_bytes long, removed array<array<long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the hash of the rest."""
    out = remove_repeats(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
