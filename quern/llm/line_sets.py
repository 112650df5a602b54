"""The similarity of lines in plain Python and numpy: what the native form of operator 8 (lines.py) is held against.

No query runs this; the comparison in full of near.py takes it as one kind of elements.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quern.llm.common import ragged

SHINGLE = 4
#: Draws of the bag of a line's shingles: the least of those that begin with each of 128 values.
BAG = 128
#: Room for the powers of the rolling hash.
BLOCK = 1 << 19


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' characters one after another, and each line's begin and size; a character stands between two lines."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32), np.cumsum(sizes + 1) - sizes - 1, sizes


_UP, _INVERSE = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)


def _powers(base: int, n: int, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  kept between calls
    """Powers of an odd base modulo 2**32."""
    out = held.get(base)
    if out is None or len(out) < n:
        out, done = np.ones(max(n, BLOCK + BLOCK // 2), np.uint32), 1
        while done < len(out):
            out[done : 2 * done] = out[: min(done, len(out) - done)] * np.uint32(pow(base, done, 1 << 32))
            done *= 2
        held.clear() if n > 4 * BLOCK else None
        held[base] = out
    return out


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _grams(flat: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the k characters from each place; its high bits are the good ones."""
    sums = np.zeros(len(flat) + 1, np.uint32)
    np.cumsum((flat + np.uint32(1)) * _powers(_UP, len(flat))[: len(flat)], out=sums[1:], dtype=np.uint32)
    return (sums[k:] - sums[:-k]) * _powers(_INVERSE, len(flat))[: len(flat) - k + 1]


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _set(line: str, k: int = SHINGLE) -> set[str]:
    """The k-character strings of a line; a shorter line is its own."""
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def similar_lines(x: list[str], y: list[str], threshold: float) -> list[bool]:
    """Whether the Jaccard similarity of each pair of lines is threshold or more."""
    out, last, a = [], None, set()
    for p, q in zip(x, y, strict=True):
        if p != last:  # a leader's pairs often follow one another
            last, a = p, _set(p)
        b = _set(q)
        both = len(a & b)
        out.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
    return out


def _shingled(lines: list[str]) -> np.ndarray:
    """Hashes of the shingles of lines without repeats, below the number of the line; a shorter line is filled up."""
    flat, begin, sizes = _points([x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\n") for x in lines])
    counts = sizes - SHINGLE + 1
    low = _mix32(_grams(flat, SHINGLE))[ragged(np.arange(max(0, len(flat) - SHINGLE + 1)), begin, counts)]
    return np.unique(np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << np.uint64(32) | low)


def _elements(threshold: float):
    """For the comparison in full (near.py): hashed shingles, of which near lines share so many; some slack for equal hashes."""

    def of(texts: pa.Array):
        lines = texts.to_pylist()
        every = _shingled(lines)
        counts = np.bincount((every >> np.uint64(32)).astype(np.int64), minlength=len(lines))
        return every.astype(np.uint32), counts, lambda n, m: (threshold / (1 + threshold) - 1e-4) * (n + m) - 1e-6, lambda i, j: similar_lines([lines[i]], [lines[j]], threshold)[0]

    return of


def bags(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of shingles of each line, and a byte for each of BAG ranges of their hashes: of the least in it, 0 for none."""
    every = _shingled(lines)
    cell = (every >> np.uint64(25)).astype(np.int64)  # line and range
    first = _edges(cell)
    out = np.zeros(len(lines) * BAG, np.uint8)
    out[cell[first]] = every[first].astype(np.uint32) * np.uint32(0x9E3779B1) % np.uint32(255) + np.uint32(1)
    return np.bincount(cell >> 7, minlength=len(lines)).astype(np.int32), out.reshape(-1, BAG).view(np.int8)
