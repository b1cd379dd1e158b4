"""Vectorised word and shingle hashing over Arrow string batches.

A batch of texts is treated as one UTF-8 byte buffer.  A 256-entry table says which bytes belong to
words, so word boundaries, 64-bit word hashes and k-word shingle hashes all come from a few NumPy
passes instead of a Python loop per word.  ASCII capitals hash like their lower-case letters; all
other bytes are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one go; longer inputs are cut between words.
PIECE_BYTES = 1 << 20
#: Bytes of text turned into word arrays at once.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _SHIFT)
    x = x * _M1
    x = x ^ (x >> _SHIFT)
    x = x * _M2
    return x ^ (x >> _SHIFT)


def _byte_codes() -> np.ndarray:
    raw = np.arange(256, dtype=np.uint64)
    raw[65:91] = raw[97:123]
    return mix(raw * np.uint64(_BASE) + np.uint64(0x51ED270B))


_CODES = _byte_codes()
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        grown = np.full(max(n, PIECE_BYTES), np.uint64(base))
        grown[0] = 1
        have = _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def whitespace_words() -> np.ndarray:
    """Words are runs of anything but space and tab to carriage return."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of all characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


@dataclass
class Words:
    """The words of a slice of texts, in order: doc is the row in the slice, start and end are byte
    positions in data, and first[i]:first[i + 1] are the words of row i."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most `limit` bytes, or of one row where that is longer."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each word."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + PIECE_BYTES, side="right")))
        high = end[to - 1]
        part = data[low:high]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * _power_table("up", _BASE, len(part)), out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (total[e] - total[s]) * _power_table("down", _INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def words_of(offsets: np.ndarray, data: np.ndarray, in_word: np.ndarray) -> Words:
    """All words of the texts that offsets cut out of data."""
    n = len(offsets) - 1
    inside = in_word[data]
    cut = offsets[1:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = cut[cut < len(data)]
    opens[cut] = inside[cut]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    ends = offsets[1:-1] - 1
    ends = ends[ends >= 0]
    closes[ends] = inside[ends]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(doc, start, end, hash_words(data, start, end), first, data)


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _weight(i: int) -> np.uint64:
    return _WEIGHTS[i] if i < 64 else mix(np.array([i + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0] | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for every start; they may cross texts, which the caller cuts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _weight(i)
    return mix(total + np.uint64(k))


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of fewer than k words: it differs from that of any other length."""
    return shingles(hashes, len(hashes))[0]


def shingle_sets(w: Words, k: int):
    """For each text, its distinct k-word shingles in ascending order; all of it where it is shorter."""
    all_of = shingles(w.hash, k)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            s = np.sort(all_of[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            yield np.array([whole(w.hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
