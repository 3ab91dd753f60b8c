"""Byte-level BPE as a monoid: encodings of neighbours are joined, halves up a tree.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs. So two encodings are joined by re-encoding a window around the boundary,
of one token on each side, then two, four and so on, until the tokens at the window's ends
and the tokens outside it are neighbours that stay: from there on nothing can change, and
the halves' outer tokens are taken as they are. Decoding has no boundary effects: it
concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare
from bizmetrics.llm.tokens import ENDS, Memory, little, units

LEAF = 8  # bytes that are merged directly
LONG = 64  # bytes from which the merge loop keeps its pairs in a heap
DECODE_LEAF = 4096  # ids that are looked up in one go
KNOWN, SHORT, PAIRS = 300_000, 150_000, 100_000  # entries of a generation of each table


class Codec:
    """Encodes and decodes with the ranks of a vocabulary; made once in a Python worker."""

    _made: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # A piece is a unit too: one table holds both.
        self._pairs, self._short, self._known = Memory(PAIRS), Memory(SHORT), Memory(KNOWN)

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls._made:
            with open(path, "rb") as lines:
                pairs = [line.split() for line in lines if line.strip()]
            cls._made[path] = cls({base64.b64decode(token): int(rank) for token, rank in pairs})
        return cls._made[path]

    def merge(self, data: bytes) -> list[int]:
        """Join the neighbours of least rank, leftmost first, until none can be joined."""
        if len(data) > LONG:
            return self._merge_long(data)
        ids = self._short.get(data)
        if ids is None:
            ids = self._merge_short(data)
            self._short.put(data, ids)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and links: for windows that had to grow far."""
        rank, n = self.ranks.get, len(data)
        end, before = [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        heap = [
            (r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been joined to another
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _merge_short(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbours are the encoding of their own bytes."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            self._pairs.put((a, b), known)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            window = b"".join([self.tokens[t] for t in left[-k:] + right[:k]])
            middle = self.merge(window)
            if (k >= len(left) or self.stays(left[-k - 1], middle[0])) and (
                k >= len(right) or self.stays(middle[-1], right[k])
            ):
                return left[:-k] + middle + right[k:]
            k *= 2

    def reduce(self, data: bytes) -> list[int]:
        """Encoding of one piece of bytes, without the look-up of the whole piece."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def _unit(self, unit: str, whole: bool = False) -> bytes:
        """Ids of a unit, or of what is known to be one piece."""
        ids = self._known.get(unit)
        if ids is None:
            word = unit[1:]
            spaced = unit[0] == " "
            if whole or spaced and word.isalpha():
                data = unit.encode()
                token = self.ranks.get(data)  # a piece that is a token is not merged
                ids = little(self.reduce(data) if token is None else [token])
            elif spaced and word[-1:] in ENDS and word[:-1].isalpha():
                ids = self._unit(unit[:-1], True) + self._unit(word[-1], True)
            else:
                ids = b"".join([self._unit(p, True) for p in self.split(unit)])
            if len(unit) < 100:
                self._known.put(unit, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for unit in units(text):
            ids = self._known.new.get(unit)
            out.append(self._unit(unit) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join([self.tokens[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text and decode the ids: ``doc_id, ids, decoded`` (both binary).

    ``ids`` are little-endian unsigned 32-bit integers. Defined cases: a null text is empty
    and has no ids; null and repeated ids and repeated rows are encoded as they come; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return _coded(docs, vocabulary, id_col, text_col, digest=False)


def digests(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``round_trip`` with SHA-256 for ids and bytes: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``."""
    return _coded(docs, vocabulary, id_col, text_col, digest=True)


def _coded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(vocabulary)
        for batch in batches:
            coded, decoded, n = [], [], []
            for text in batch.column(0):
                ids = codec.encode(text.as_py() or "")
                back = codec.decode(np.frombuffer(ids, "<u4"))
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
            if digest:
                columns = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array(coded, pa.binary()), pa.array(decoded, pa.binary())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["doc_id", *names])

    if digest:
        return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
