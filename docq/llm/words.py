"""Words and shingles of whole text columns, hashed with numpy.

A batch is one buffer of UTF-8 bytes; words are runs of bytes of a class, so
neither texts nor words become Python objects.  Hashes are 64-bit and depend
on the bytes alone: equal on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes worked on at once; a longer text is a piece of its own.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)


def byte_class(pattern_bytes) -> np.ndarray:
    """256 booleans: which bytes, after lower-casing A-Z, belong to words."""
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return out


#: Everything but space and \t \n \v \f \r.
NON_SPACE = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM = byte_class(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


@dataclass
class Words:
    """Words of texts first..first+n: hashes in order, counts per text."""

    first: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte ranges in raw
    ends: np.ndarray
    raw: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def word_runs(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes; no word crosses a text's end."""
    inside = kind[low]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at] = inside[at]
    last[end] = inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_runs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run, whatever its place; in pieces of about CHUNK bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    lens = ends - starts
    total = np.cumsum(lens)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK)))
        n, s = lens[at:to], starts[at:to]
        head = np.cumsum(n) - n
        rel = np.arange(int(n.sum())) - np.repeat(head, n)
        vals = _BYTE[low[np.repeat(s, n) + rel]] * _powers(int(n.max()))[rel]
        out[at:to] = mix(np.add.reduceat(vals, head) + n.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def words_of(texts: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """The texts of an Arrow array, a piece of about CHUNK bytes at a time."""
    offsets, raw = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        off = offsets[at : to + 1] - offsets[at]
        low = _LOWER[raw[offsets[at] : offsets[to]]]
        starts, ends = word_runs(low, off, kind)
        counts = np.diff(np.searchsorted(starts, off))
        yield Words(at, counts, hash_runs(low, starts, ends), starts, ends, low)
        at = to


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words; empty where there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, int(k) * 0xA24BAED4963EE407 % 2**64, dtype=np.uint64)
    for j in range(k):
        out *= U(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
        out ^= out >> U(29)
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles, sorted; the whole sequence as one where it has
    fewer words; empty where it has none."""
    return np.unique(shingles(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)
