"""Byte-level BPE encoding of whole texts by way of small pieces that repeat.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges bytes inside each of
them, so the ids of a text are the ids of its pre-tokens in a row.  Real corpora repeat most
pre-tokens, hence each worker keeps what it has encoded.

A text is cut in one of three ways, all of which give the library's own ids:

* plain texts (no special strings, no unusual white space) are cut at spaces and before line feeds,
  where the pre-tokenizer always cuts as well; a piece may hold several pre-tokens;
* other texts of well-known letters are cut into pre-tokens by the published pattern;
* what is left goes through the library whole.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

#: White space other than the space and the line feed; the pre-tokenizer joins runs that hold it.
UNUSUAL = re.compile("[" + "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")
#: Characters on whose class libraries of different Unicode versions could differ.
EXOTIC = re.compile("|".join(f"[{chr(a)}-{chr(b)}]" for a, b in ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x250, 0x36F), (0x500, 0x200F), (0x2028, 0x202F), (0x205F, 0x209F), (0x20C0, 0x10FFFF))))
#: The pre-token pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern never joins with letters before them, but always with each other.
STOPS = ".,;:!?*$&%#)]}"
#: Pieces longer than this are encoded each time; keeping them would fill the cache.
LONG_PIECE = 64


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the rest are numbered on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + others.index(b) for b in range(256)}


def byte_level(path: str) -> bool:
    """Whether a tokenizer's file says all that the cutting below takes for granted: plain byte-level BPE with
    the published pattern, nothing added in front and no normaliser.  Any other goes through the library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and spec.get("normalizer") is None and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    )


class Tokenizer:
    """The tokenizer of one worker process."""

    def __init__(self, path: str, plain: bool | None = None):
        """plain is byte_level(path), if that is known."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.plain = byte_level(path) if plain is None else plain
        self.pretokens = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def model(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        if word[0] == " " and word.isascii() and word[1:].isalnum():
            word = "\u0120" + word[1:]
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(word)]

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text, or None.  A piece that doesn't begin with a line feed stands for
        itself with a space before it; "\\0" marks one without."""
        if not self.plain:
            return None
        for s in self.special:
            if s in text:
                return None
        if not ("  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or "\0" in text or text.endswith("\n\n") or UNUSUAL.search(text)):
            cut = text.replace("\n", " \n").split(" ")
            if cut[0]:
                cut[0] = "\0" + cut[0]
                return cut
            return cut[1:]
        if "\0" in text or EXOTIC.search(text):
            return None
        return ["\0" + p for p in self.pretokens(text)]


def spelled(piece: str) -> str:
    """The text that a piece of Tokenizer.cut stands for."""
    if piece[:1] == "\0":
        return piece[1:]
    return piece if piece[:1] == "\n" else " " + piece


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is
    asked for again moves back.  `fixed` entries always stay."""

    def __init__(self, room: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.room, self.fixed, self.old = room, fixed or {}, {}

    def unknown(self, keys) -> list:
        """The keys that have to be worked out; all others are in this dict afterwards."""
        if len(self) - len(self.fixed) > self.room:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        lacking = set(keys).difference(self)
        known = lacking.intersection(self.old)
        if known:
            self.update(zip(known, map(self.old.__getitem__, known)))
            lacking.difference_update(known)
        return list(lacking)


class Encoded:
    """What a worker knows of pieces.  value turns the ids of a pre-token into what is kept, and join
    makes that of a piece or text from those of its parts.  frequent, if given, is a fixed first tier of
    pre-tokens; what isn't there is encoded, and its piece is kept while it is used."""

    def __init__(self, tokenizer: Tokenizer, value, join, frequent: dict | None = None, room: int = 200_000):
        self.tokenizer, self.value, self.join, self.frequent = tokenizer, value, join, frequent or {}
        self.pieces, self.stops = Recent(room), {}

    def learn(self, pieces) -> dict:
        """Works out the unknown pieces among these; returns those too long to keep."""
        new = self.pieces.unknown(pieces)
        kept, stops, value, join, tokenizer = self.pieces, self.stops, self.value, self.join, self.tokenizer
        tokenize, model, letters, frequent, found = tokenizer.tokenize, tokenizer.model, tokenizer.letters, self.frequent, {}
        for piece in new:
            word = piece.rstrip(STOPS)
            if word.isalpha() and (word.isascii() or not EXOTIC.search(word)):
                # letters and stops: two pre-tokens, known without the pattern
                made = frequent.get(" " + word)
                if made is None:
                    spelt = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                    made = value([t.id for t in tokenize("\u0120" + spelt)])
                if len(word) < len(piece):
                    tail = piece[len(word) :]
                    if tail not in stops:
                        if len(stops) > 1000:
                            stops.clear()
                        stops[tail] = frequent[tail] if tail in frequent else value(model(tail))
                    made = join((made, stops[tail]))
            else:
                made = join([frequent[w] if w in frequent else value(model(w)) for w in tokenizer.pretokens(spelled(piece))])
            (kept if len(piece) <= LONG_PIECE else found)[piece] = made
        return found

    def texts(self, texts: list[str]) -> list:
        """The joined value of each text."""
        cuts = [self.tokenizer.cut(t) for t in texts]
        long = self.learn(chain.from_iterable(c for c in cuts if c))
        whole = iter(self.tokenizer.encode([t for c, t in zip(cuts, texts) if c is None]))
        get = self.pieces.__getitem__
        if long:
            get = lambda p: self.pieces[p] if p in self.pieces else long[p]
        return [self.value(next(whole)) if c is None else self.join(map(get, c)) for c in cuts]


def id_bytes(vocabulary: int):
    """ids -> bytes, two or four for each id."""
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    code = "H" if kind.itemsize == 2 else "I"
    return kind, (lambda ids: array(code, ids).tobytes())


def released() -> None:
    """Gives memory that isn't in use any more back to the system: worker processes are used again by later
    stages, and what they hold counts for the executor all the time."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_made: dict = {}


def worker(key, make):
    """make(), once for each worker process and key; what was made for another key goes."""
    if key not in _made:
        _made.clear()
        released()
        _made[key] = make()
    return _made[key]
