"""Operator 4: byte-level BPE encoding and decoding.

Pieces (matches of the split pattern) are encoded together: pieces of similar
length are rows of one padded matrix, every row merges its leftmost pair of
minimum rank each round, pair ranks come from an open-addressing hash table, and
rows without a mergeable pair leave the matrix. Pieces longer than LONG bytes
would make wide matrices with many rounds; they take an exact heap over the same
pair table instead.

Memory: texts are cut into blocks of about a million characters; a worker keeps at
most CACHE encoded pieces. Nothing is shuffled.

Defined results: null and empty texts have no tokens; repeated rows give repeated
rows; any code points are encoded, as bytes have ids of their own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import chunks, lean, ragged, small_batches, text_or_empty

LONG = 256
CACHE = 1 << 18
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[tuple[str, str], "Encoder"] = {}


class PairTable:
    """(left id, right id) -> id of the merged token: linear probing in one numpy table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            first = np.unique(s, return_index=True)[1]
            free = first[self.keys[s[first]] < 0]
            self.keys[s[free]], self.values[s[free]] = keys[left[free]], values[left[free]]
            slot[left] = (s + 1) & self.mask
            left = np.delete(left, free)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the pair doesn't merge or a side is padding (below 0)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(a << 32) | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.pair_dict = pairs
        self.pairs = PairTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.token_flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_lens = np.array([len(t) for t in self.tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self._forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> "Encoder":
        """One encoder for each worker process."""
        if (path, pattern) not in _loaded:
            with open(path, "rb") as f:
                _loaded[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return _loaded[path, pattern]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool_ids, self.pool_starts, self.pool_lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in blocks, so that a huge text isn't held as pieces."""
        if len(text) <= 1 << 20:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(islice(found, 1 << 17)):
            yield block

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        counts, out, block, of = np.zeros(len(texts), np.int64), [], [], []

        def flush() -> None:
            ids, lens = self._encode_pieces(block)
            np.add.at(counts, np.array(of, np.int64)[:, 0], np.add.reduceat(lens, np.array(of, np.int64)[:, 1])) if len(block) else None
            out.append(ids)
            block.clear()
            of.clear()

        for i, text in enumerate(texts):
            for got in self.pieces(text):
                if got:
                    of.append((i, len(block)))
                    block += got
                if len(block) > 1 << 17:
                    flush()
        if block:
            flush()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE:
            self._forget()
        index = self.index
        new = [p for p in set(pieces) if p not in index]
        if new:
            for i, p in enumerate(new, len(index)):
                index[p] = i
            flat, lens = self._merge_all([p.encode() for p in new])
            starts = np.cumsum(lens) - lens + len(self.pool_ids)
            self.pool_ids = np.concatenate([self.pool_ids, flat])
            self.pool_starts, self.pool_lens = np.concatenate([self.pool_starts, starts]), np.concatenate([self.pool_lens, lens])
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        lens = self.pool_lens[at]
        return ragged(self.pool_ids, self.pool_starts[at], lens), lens

    def _merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens, rest, done = np.zeros(len(pieces), np.int64), {}, {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                done[i] = [rank]
            elif len(p) > LONG:
                done[i] = self._heap(p)
            else:
                rest.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in rest.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    done[i] = ids
        for i, ids in done.items():
            lens[i] = len(ids)
        return np.fromiter((x for i in range(len(pieces)) for x in done[i]), np.int32, int(lens.sum())), lens

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n, lens = len(pieces), np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out, row, column = [None] * n, np.arange(n), np.arange(width)
        while len(row):
            at = ranks.argmin(1)  # the first of equal ranks: the leftmost
            best = ranks[np.arange(len(row)), at]
            go = best < NONE
            if not go.all():
                for k in np.flatnonzero(~go):
                    out[row[k]] = ids[k, : lens[k]].copy()
                row, ids, ranks, lens, at, best = row[go], ids[go], ranks[go], lens[go], at[go], best[go]
                if not len(row):
                    break
                used = max(2, int(lens.max()))
                ids, ranks, column = ids[:, :used], ranks[:, :used], column[:used]
            here = np.arange(len(row))
            ids[here, at] = best
            take = np.minimum(column + (column > at[:, None]), len(column) - 1)
            last = ids.shape[1] - 1
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            lens = lens - 1
            ids[:, last], ranks[:, last] = np.where(at < last, -1, ids[:, last]), NONE
            ids[column >= lens[:, None]] = -1
            ranks[here, at] = self.pairs.get(ids[here, at], ids[here, np.minimum(at + 1, last)])
            ranks[here[at == last], last] = NONE
            some = here[at > 0]
            ranks[some, at[some] - 1] = self.pairs.get(ids[some, at[some] - 1], ids[some, at[some]])
        return out

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pair_dict.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := get((ids[x] << 32) | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids as uint8."""
        return ragged(self.token_flat, self.token_starts[ids], self.token_lens[ids])

    def count(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts)[1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with token_ids array<int>; with decoded, also the bytes that the ids stand for.

    path: a file of ranks in the tiktoken form that every executor can open.
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in (text, "token_ids", "decoded")]
    fields = [*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField("decoded", T.BinaryType(), False)] * decoded
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for a, b in chunks(texts):
                ids, counts = encoder.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns = [batch.column(k).slice(a, b - a) for k in range(len(names))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                if decoded:
                    flat = encoder.decode(ids)
                    sizes = np.concatenate([[0], np.cumsum(encoder.token_lens[ids])])[ends]
                    columns.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        encoder._forget()
        lean()

    return docs.select(*names, text_or_empty(text).alias("_text")).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """encoded with the bytes of its ids as column decoded; a null list of ids gives no bytes."""
    keep = [f for f in encoded.schema.fields if f.name not in (ids, "decoded")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        for batch in batches:
            out = [encoder.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names, F.col(ids)).mapInArrow(run, T.StructType([*keep, T.StructField("decoded", T.BinaryType(), False)]))


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digest(docs: DataFrame) -> DataFrame:
    """Per document: number and hash of its ids, and the hash of what they decode to."""
    out = encode(docs.select("doc_id", "text"), *public_vocabulary(), decoded=True)
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
