"""Token ids of whole texts with the tokenizers library, piece by piece.

A byte-level tokenizer splits a text before it merges, and a single space between two
characters that are no white space always starts a piece. So a text is the sequence of its
units between such spaces, and each unit's ids stand for themselves. The units of a chunk of
documents are cut, hashed and looked up by array operations in a table of bounded size; the
library only sees, once each, those that are not known there. The ids of all documents are
then gathered by offsets.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from bizmetrics.llm.text import Chunk, chunks, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLOTS = 21  # bits: so many places has the table of known units
POOL = 1 << 23  # ids of known units, at which the table is emptied
PIECES = 50_000  # short pieces of odd units that are kept besides
CHUNK = 1 << 22  # bytes whose units are looked up at a time
_UNIT, _CHECK = 51, 52
# A space that starts a piece: beside white space the library decides.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_BEFORE = re.compile(r" \s")
_AFTER = re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
# White space beyond ASCII: a document with any is one unit, cut by the library's pattern.
_RARE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
# Marks after which, and before the end, no piece goes on.
ENDS = frozenset(".,;:!?")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    letters = {b: chr(b) for b in _PRINTABLE}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(_PRINTABLE))
    return letters


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Memory:
    """A table that forgets: at ``size`` new entries the ones not used since then go."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def units(text: str) -> list[str]:
    """A text, cut before single spaces that stand between characters of words."""
    if text[0] == " " or text[-1] == " " or _BEFORE.search(text) or _AFTER.search(text):
        words = _SPLIT.split(text)
    else:
        words = text.split(" ")
    return words[:1] + [" " + word for word in words[1:]]


def unit_starts(chunk: Chunk) -> np.ndarray:
    """Where the units of a chunk start: at each document, and at single spaces between
    characters that are no white space."""
    data, n = chunk.data, len(chunk.data)
    white = np.ones(n + 2, bool)
    white[1:-1] = _WHITE[data]
    start = (data == 32) & ~white[:-2] & ~white[2:]
    # At the edges of documents a space is not between characters.
    filled = np.flatnonzero(np.diff(chunk.offsets))
    start[chunk.offsets[1:][filled] - 1] = False
    start[chunk.offsets[:-1][filled]] = True
    if b"\xc2" in (raw := data.tobytes()) or b"\xe1" in raw or b"\xe2" in raw or b"\xe3" in raw:
        for match in _RARE.finditer(raw):
            doc = int(np.searchsorted(chunk.offsets, match.start(), "right")) - 1
            start[chunk.offsets[doc] + 1 : chunk.offsets[doc + 1]] = False
    return np.flatnonzero(start)


class Known:
    """Ids of units by 128 bits of hash: an open table whose look-ups are array operations."""

    PROBES = 24

    def __init__(self, bits: int = SLOTS, pool: int = POOL):
        self.mask, self.limit = (1 << bits) - 1, pool
        self.clear()

    def clear(self) -> None:
        size = self.mask + 1
        self.first, self.second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.top, self.used = np.zeros(self.limit, "<u4"), 0, 0

    def full(self) -> bool:
        return self.top >= self.limit or 2 * self.used > self.mask

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not known."""
        out = np.full(len(first), -1, np.int64)
        slot = (first & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(first))
        for _ in range(self.PROBES):
            held = self.first[slot]
            here = (held == first[left]) & (self.second[slot] == second[left])
            out[left[here]] = slot[here]
            on = ~here & (held != 0)
            if not on.any():
                break
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, first: np.ndarray, second: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Keys that are not known yet, each once; one that finds no place is not kept."""
        slot = (first & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(first))
        for _ in range(self.PROBES):
            # Of those that want a free slot one gets it.
            taken, which = np.unique(slot, return_index=True)
            free = self.first[taken] == 0
            taken, which = taken[free], which[free]
            own = left[which]
            self.first[taken], self.second[taken] = first[own], second[own]
            self.start[taken], self.length[taken] = start[own], length[own]
            self.used += len(own)
            on = np.ones(len(left), bool)
            on[which] = False
            left, slot = left[on], (slot[on] + 1) & self.mask
            if not len(left):
                break

    def keep(self, ids: np.ndarray) -> int:
        """Append ids to the pool, which may pass its limit until it is emptied."""
        at = self.top
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(ids), len(self.pool)), "<u4")])
        self.pool[at : at + len(ids)] = ids
        self.top += len(ids)
        return at


class Encoder:
    """Ids as unsigned 32-bit integers; made once in a Python worker."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.known, self.pieces = Known(), Memory(PIECES)

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merged(self, piece: str) -> bytes:
        """Ids of what is known to be one piece."""
        if piece[0] == " " and piece.isascii() and piece[1:].isalnum():
            letters = self.space + piece[1:]
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return little([t.id for t in self.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._merged(piece)
            if len(piece) < 9:
                self.pieces.put(piece, ids)
        return ids

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit that is not known."""
        if unit[0] == " ":
            word = unit[1:]
            if word.isalpha():
                return self._merged(unit)
            if word[-1:] in ENDS and word[:-1].isalpha():
                return self._merged(unit[:-1]) + self._piece(word[-1])
        return b"".join([self._piece(p) for p in self.split(unit)])

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, end to end, and the bounds of each one's."""
        starts = unit_starts(chunk)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(chunk.size + 1, np.int64)
        known = self.known
        if known.full():
            known.clear()
        stops = np.append(starts[1:], len(chunk.data))
        first = np.maximum(word_hashes(chunk, starts, stops, _UNIT), np.uint64(1))
        second = word_hashes(chunk, starts, stops, _CHECK)
        slot = known.find(first, second)
        begin, length = known.start[slot], known.length[slot].astype(np.int64)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            # The unit that a hash first comes with stands for all: 64 bits tell them apart
            # within a chunk, and the others are checked.
            _, which, of = np.unique(first[missing], return_index=True, return_inverse=True)
            some = missing[which]
            raw = chunk.data.tobytes()
            new = [
                self._unit(raw[a:b].decode())
                for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)
            ]
            sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
            at = known.keep(np.frombuffer(b"".join(new), "<u4")) + np.cumsum(sizes) - sizes
            begin[missing], length[missing] = at[of], sizes[of]
            known.add(first[some], second[some], at, sizes.astype(np.int32))
            for i in np.flatnonzero(second[some][of] != second[missing]).tolist():
                k = missing[i]
                ids = np.frombuffer(self._unit(raw[starts[k] : stops[k]].decode()), "<u4")
                begin[k], length[k] = known.keep(ids), len(ids)
        ends = np.cumsum(length)
        at = np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]))
        bounds = np.append(0, ends)[np.searchsorted(starts, chunk.offsets)]
        return known.pool[at], bounds

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column; a null has none."""
        for chunk in chunks(column, size=CHUNK):
            ids, bounds = self.encode_chunk(chunk)
            for i in range(chunk.size):
                yield ids[bounds[i] : bounds[i + 1]]

    def encode(self, text: str) -> bytes:
        return next(self.encode_column(pa.array([text]))).tobytes()
