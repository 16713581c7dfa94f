"""Text as numpy arrays: words, rolling hashes and windows, one text at a time.

Texts are taken as UTF-8 bytes. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D, which never occur inside a multi-byte character, so byte
words and character words are the same. Hashes are 64-bit; two of them are
combined wherever equality decides a result over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit value; one to one."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (at least); grown on demand."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(1 << 16, 2 * n), _BASES[which]
        both = []
        for value in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(value))
            p[0] = U(1)
            both.append(np.multiply.accumulate(p))
        have = _powers[which] = (both[0], both[1])
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """H with H[j] - H[i] = the hash of data[i:j] times base**i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data), which)[0][: len(data)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[start:end], equal for equal contents wherever they stand."""
    return mix((h[end] - h[start]) * powers(len(h), which)[1][start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hash(prefix_hash(data, which), starts, ends, which)


def window_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of *n* consecutive items; empty where there are fewer."""
    m = len(items) - n + 1
    if m < 1:
        return np.zeros(0, U)
    total = np.zeros(m, U)
    for j in range(n):
        total = total * U(0x9E3779B97F4A7C15) + items[j : j + m]
    return mix(total)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the *size*-word shingles; A-Z count as a-z.

    Fewer words make one element of the whole sequence; no words, no element.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, U)
    words = word_hashes(data, starts, ends)
    if len(words) < size:
        return window_hashes(words, len(words)) ^ U(len(words))
    return np.unique(window_hashes(words, size))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of *length* beginning at one of *starts*."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def slices(texts: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with about *limit* bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
