"""Substrings of words as numbers, cut for all words of a batch at once.

A character is a number of 12 bits, so a substring of at most five is one number of 60 bits, shorter ones with zeros behind.  Where texts have more
characters than that (or the character 0) there is no such number, and words are cut one by one (`topk.Terms`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS, LONGEST = 12, 5
MOST_CHARACTERS = (1 << BITS) - 1


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words, and the lengths of words."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def starts(x: np.ndarray) -> np.ndarray:
    """Where equal numbers of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])


class Grams:
    """The numbers of substrings of some lengths, and the characters that they are made of."""

    def __init__(self, grams: tuple[int, int], alphabet: pa.Array | None = None):
        """With an alphabet, terms that have all characters that count, others are left out; `fits` tells whether it could be taken."""
        self.low, self.high = grams
        self.number = np.zeros(0x110000, np.uint16)
        self.points = np.zeros(1, np.uint32)
        self.grows = alphabet is None
        self.fits = self.high <= LONGEST and (self.grows or self._add(points(alphabet.to_pylist())[0]))

    def _add(self, flat: np.ndarray) -> bool:
        there = np.zeros(0x110000 if len(flat) > 1 << 20 else 0, bool)
        there[flat if len(there) else []] = True
        new = np.flatnonzero(there & (self.number == 0)) if len(there) else np.unique(flat[self.number[flat] == 0])
        if len(new) and new[0] == 0 or len(self.points) + len(new) > MOST_CHARACTERS + 1:
            return False
        self.number[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points = np.concatenate((self.points, new.astype(np.uint32)))
        return True

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The numbers of terms of at most five characters, none empty, all of known characters."""
        flat, sizes = points(terms.to_pylist())
        if not len(sizes):
            return np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        return np.add.reduceat(self.number[flat].astype(np.int64) << (BITS * place), first)

    def names(self, codes: np.ndarray) -> pa.Array:
        out = np.zeros((len(codes), LONGEST), np.uint32)
        for j in range(LONGEST):
            out[:, j] = self.points[(codes >> (BITS * j)) & MOST_CHARACTERS]
        return pa.array(out.view(f"<U{LONGEST}").ravel().tolist(), pa.string())

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The numbers of all substrings, word by word, and how many each word has; None if there are too many characters."""
        flat, sizes = points(words)
        if self.grows and not self._add(flat):
            return None
        c = self.number[flat].astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        known = np.zeros(len(c), np.int64)  # how many known characters follow, up to the longest
        for j in range(self.high - 1, -1, -1):
            known[: len(c) - j] = np.where(c[j:] > 0, known[: len(c) - j] + 1, 0)
        known = np.minimum(known, left)
        code, found, where = np.zeros(len(c), np.int64), [], []
        for n in range(1, self.high + 1):
            code[: len(c) - n + 1] |= c[n - 1 :] << (BITS * (n - 1))
            if n >= self.low:
                on = np.flatnonzero(known >= n)
                found.append(code[on])
                where.append(word[on])
        found, where = np.concatenate(found), np.concatenate(where)
        return found[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(sizes))

    def counts(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(document, substring, tf) of lists of words, in the order of documents, and the numbers of the substrings; None if there are too many characters."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        cut = self.cut(coded.dictionary.to_pylist())
        if cut is None:
            return None
        distinct, ids = np.unique(cut[0], return_inverse=True)
        each, n_words = cut[1], max(1, len(cut[1]))
        # words of a document are counted before they are cut
        pairs = np.sort(np.repeat(np.arange(len(sizes)), sizes) * n_words + coded.indices.to_numpy(zero_copy_only=False))
        first = starts(pairs)
        times = np.diff(np.append(first, len(pairs)))
        doc, word = np.divmod(pairs[first], n_words)
        n = each[word]
        at = np.repeat((np.cumsum(each) - each)[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        v = max(1, len(distinct))
        key, times = np.repeat(doc * v, n) + ids[at], np.repeat(times, n)
        bits = int(times.max()).bit_length() if len(times) else 1
        if (len(sizes) * v) << bits < 1 << 62:
            key = np.sort(key << bits | times)
            key, times = key >> bits, key & ((1 << bits) - 1)
        else:
            order = np.argsort(key)
            key, times = key[order], times[order]
        first = starts(key)
        tf = np.add.reduceat(times, first) if len(first) else first
        return *np.divmod(key[first], v), tf, distinct


class Table:
    """Values of numbers."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, missing):
        order = np.argsort(codes)
        self.codes, self.values, self.missing = codes[order], values[order], missing

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), self.missing)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], self.missing)
