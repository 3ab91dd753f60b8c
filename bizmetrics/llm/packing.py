"""Packing of token pieces into sequences: dominance reduction, then best fit.

Only lengths matter, and a length is at most the capacity. So the plan is made on counts by
length, a table of ``capacity`` numbers whatever the input: the dominance criterion of
Martello and Toth first fixes sets that no other set for the same long piece can beat, and
best fit decreasing fills the rest, a whole run of equal sequences at a time. The plan says,
for each length, which ranks go to which run of sequences; every piece then finds its place
from its own rank, which comes from counts by writing task. No piece leaves the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare, store
from bizmetrics.llm.tokens import Encoder

CAPACITY = 2048
END = 0

# A sequence's content: (length, how many of it), longest first.
Pattern = tuple[tuple[int, int], ...]


def reduce(counts: Counter[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, longest piece first; takes them out of ``counts``.

    With j a piece and s1 <= s2 <= ... the others: if s1 doesn't fit beside j, j is alone; if
    s1 + s2 doesn't, the longest i that fits is j's partner; i also is, if it fills the
    sequence, or if s1 + s2 + s3 doesn't fit and no two pieces that fit are longer than i.
    """
    fixed: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, times: int) -> None:
        for length, k in pattern:
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        fixed.append((pattern, times))

    def smallest(but: int, k: int) -> list[int]:
        out: list[int] = []
        for length in sorted(counts):
            out += [length] * min(k - len(out), counts[length] - (length == but))
            if len(out) == k:
                break
        return out

    def best_pair(but: int, room: int) -> int:
        """Largest sum of two pieces that fit in ``room``, one ``but`` left out."""
        lengths = [x for x in sorted(counts) if counts[x] > (x == but)]
        low, high, best = 0, len(lengths) - 1, 0
        while low <= high:
            total = lengths[low] + lengths[high]
            if total > room:
                high -= 1
            elif low == high and counts[lengths[low]] - (lengths[low] == but) < 2:
                break
            else:
                best, low = max(best, total), low + 1
        return best

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room, few = capacity - j, smallest(j, 3)
            if not few or few[0] > room:
                take(((j, 1),), counts[j])
                continue
            partner = max((x for x in counts if x <= room and counts[x] > (x == j)), default=0)
            alone = len(few) < 2 or few[0] + few[1] > room
            two = len(few) < 3 or sum(few) > room
            if not (alone or partner == room or two and partner >= best_pair(j, room)):
                break
            if partner == j:
                take(((j, 2),), counts[j] // 2)
            elif partner == room:
                take(((j, 1), (partner, 1)), min(counts[j], counts[partner]))
            else:
                # The criterion depends on what is left: look again when a length runs out.
                take(((j, 1), (partner, 1)), min(counts[j], counts[partner]))
    return fixed


def best_fit(counts: Counter[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over equal pieces and equal sequences at a time."""
    rooms: list[int] = []  # sorted remaining rooms with open sequences
    open_: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            # The sequence just filled is the fullest that fits, so it takes the next too.
            k = room // length
            full = min(times, left // k)
            put(room - k * length, (*pattern, (length, k)), full)
            left -= k * full
            used = full
            if full < times and 0 < left < k:
                put(room - left * length, (*pattern, (length, left)), 1)
                left, used = 0, full + 1
            if pattern:
                put(room, pattern, times - used)
    return [entry for entries in open_.values() for entry in entries]


def plan(counts: Counter[int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), sorted."""
    rest = Counter({length: n for length, n in counts.items() if n})
    runs = reduce(rest, capacity) + best_fit(rest, capacity)
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in runs:
        offset = 0
        for length, k in pattern:
            rows.append((length, rank[length], sequence, k, offset))
            rank[length] += k * times
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int | None = END,
) -> DataFrame:
    """Encode each text, append ``end``, cut what is longer than ``capacity``; stored.

    The first piece of a cut document takes what the others leave. ``task`` and ``nth`` number
    the pieces of a length. A text without ids (null or empty, and no ``end``) has no piece.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.get(tokenizer), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            which, out = [], []
            for i, ids in enumerate(encoder.encode_column(batch.column(0))):
                ids = ids.tobytes() + tail
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity)
                    out.append((piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), task, seen[stop - start]))
                    which.append(i)
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(which, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return store(
        rows.mapInArrow(
            cut,
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long",
        ),
        "pieces",
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place stored pieces (``length, task, nth`` and others) in sequences.

    Adds ``sequence_id`` and ``offset``; sequences are filled from 0 without gaps. Equal
    pieces are told apart by task and number, so repeated rows are as many pieces.
    """
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # One row a length: at most ``capacity`` of them.
    counts = Counter({r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    if any(length > capacity for length in counts):
        raise ValueError("a piece is longer than the capacity")
    rows = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("task", "nth")], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        # Length and first rank in one sortable number.
        keys = table[:, 0].astype(object) * (1 << 48) + table[:, 1]
        keys = keys.astype(np.int64)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            own = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int | None = END,
) -> DataFrame:
    """Tokenize, cut and pack all texts: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Defined cases: null text is empty, its piece is the end id; null and repeated ids and
    repeated rows are packed as they come; an empty table has no sequence; other columns are
    ignored, whatever their names.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity, end), capacity)
