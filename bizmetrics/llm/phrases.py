"""Phrase collocations: n-grams of words enumerated in FM-indexes of shards, counts summed.

A shard holds some MB of one language's texts as word numbers with a 0 between pieces. Its
rows are the word positions sorted by the ``DEPTH`` words that start there; the column before
them is the shard's Burrows-Wheeler transform, and ``psi``, the inverse of its LF mapping,
leads from a row to the row one word on. An n-gram is an interval of rows. Extended by a word
to the left, an interval becomes the run of rows that LF maps its rows with that word before
them to; extended to the right, it splits into runs within itself. Both meet in one interval
of the longer n-gram, so the n-gram is named by its first and its last n - 1 words, and all
intervals of a depth are extended at once, by array operations.

Counts of a depth are summed across the shards by Spark, keyed by those two names. Only
n-grams that reach ``least`` in all shards together go back to the shards to be extended: a
longer one can't be more frequent than its parts. A name is the place of the n-gram's first
interval (shard and row), so it is exact and costs no dictionary. A shard sends one row an
n-gram, however often that stands there, so no key holds more rows than there are shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.llm.shared import drop, prepare, store
from bizmetrics.llm.text import chunks, word_bounds

DEPTH = 4
LEAST = 30
TOP = 2000
SHARD = 1 << 22  # bytes of text; a longer text is a shard of its own
HELD = 4 * SHARD  # bytes of all languages that a task keeps for their shards
_NTH, _ROW = 10, 31  # bits of a shard's number in its task, of a row in its shard
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(b".,;:!?\n\v\f\r")] = True
_GAP = _SEPARATORS.copy()
_GAP[list(b" \t")] = True


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers, most of them small, as compressed planes of their bytes."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def word_numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of lower-cased texts, their counts, and all words in order as numbers
    from 1 with a 0 wherever a piece or a text ends."""
    size = texts.nbytes + 1
    for chunk in chunks(texts, lower=True, size=size):
        starts, ends, first = word_bounds(chunk, _GAP)
        data = chunk.data[~_GAP[chunk.data]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        number = words.indices.to_numpy()
        piece = np.concatenate([[0], np.cumsum(_SEPARATORS[chunk.data], dtype=np.int32)])[starts]
        piece = piece + np.repeat(np.arange(chunk.size), np.diff(first))
        at = np.arange(1, len(starts) + 1)
        if len(piece):
            at[1:] += np.cumsum(piece[1:] != piece[:-1])
        out = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.int32)
        out[at] = number + 1
        return words.dictionary.cast(pa.large_string()), np.bincount(number, minlength=len(words.dictionary)), out
    return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(1, np.int32)


def shards(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """``shard, lang, words, counts, numbers`` from ``text, lang``; stored."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal nth
            if nth >> _NTH:
                raise ValueError(f"more than {1 << _NTH} shards in a task: use smaller splits or larger shards")
            words, counts, numbers = word_numbers(pa.concat_arrays(held.pop(lang)))
            del sizes[lang]
            shard = task << _NTH | nth
            nth += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()), pa.array([lang]),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts.astype(np.int64))),
                    pa.array([packed(numbers)], pa.binary()),
                ],
                names=["shard", "lang", "words", "counts", "numbers"],
            )

        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(0).filter(pa.array(langs.indices.to_numpy() == code)).drop_null()
                if len(own):
                    held.setdefault(lang, []).append(own)
                    sizes[lang] = sizes.get(lang, 0) + own.nbytes
                    if sizes[lang] >= size:
                        yield flush(lang)
            while sum(sizes.values()) > max(HELD, 4 * size):
                yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    return store(
        rows.select("text", "lang").mapInArrow(
            build, "shard long, lang string, words array<string>, counts array<long>, numbers binary"
        ),
        "phrase-shards",
    )


def index(numbers: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``psi`` and the name of the first word of each row (-1: none).

    ``names`` holds the names of the word numbers, -1 for words that no n-gram needs; these
    are as good as the end of a piece.
    """
    kept = np.concatenate([[-1], names])
    local = np.zeros(len(kept), np.int64)
    local[kept >= 0] = np.arange(1, (kept >= 0).sum() + 1)
    symbols = local[numbers]
    # Ends beside each other are one.
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    symbols = symbols[keep]
    # Ranks of two, then of four words, by doubling.
    ranks, width = symbols, 1
    while width < DEPTH:
        far = np.concatenate([ranks[width:], np.zeros(width, np.int64)])
        ranks = np.unique(ranks * (int(far.max(initial=0)) + 1) + far, return_inverse=True)[1]
        width *= 2
    rows = np.argsort(ranks, kind="stable")
    before = symbols[rows - 1]
    psi = np.argsort(before, kind="stable").astype(np.int32)
    of_symbol = np.concatenate([[-1], kept[kept >= 0]])
    return psi, of_symbol[symbols[rows]]


def extend(psi: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the n-grams one word longer than those that ``names`` gives the rows:
    first row, length, and the names of the first and the last words."""
    after = names[psi]
    some = np.flatnonzero((names >= 0) & (after >= 0))
    first, last = names[some], after[some]
    new = np.ones(len(some), bool)
    new[1:] = (some[1:] != some[:-1] + 1) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    at = np.flatnonzero(new)
    return some[at], np.diff(np.append(at, len(some))), first[at], last[at]


def _rows_named(size: int, lows: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.full(size, -1, np.int64)
    out[np.repeat(lows - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = np.repeat(names, lengths)
    return out


def _intervals(indexed: DataFrame) -> DataFrame:
    """``n, shard, first, last, low``: all n-grams one word longer, of each shard. What a row
    shares with the one before it stands first and in one piece: the shuffle packs it best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, psi, lows, lengths, names in zip(*batch.columns, strict=True):
                psi = np.cumsum(unpacked(psi.as_py()), dtype=np.int32)  # ascending for each word
                named = _rows_named(len(psi), *(c.values.to_numpy().astype(np.int64) for c in (lows, lengths, names)))
                low, n, first, last = extend(psi, named)
                for a in range(0, len(low), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(n[part].astype(np.int32)), pa.array(np.full(len(low[part]), shard.as_py())),
                            pa.array(first[part]), pa.array(last[part]), pa.array(low[part].astype(np.int32)),
                        ],
                        names=["n", "shard", "first", "last", "low"],
                    )

    return indexed.select("shard", "psi", "lows", "lengths", "names").mapInArrow(
        run, "n int, shard long, first long, last long, low int"
    )


def _place(low: str) -> Column:
    return F.shiftleft("shard", _ROW).bitwiseOR(F.col(low).cast("long"))


def _frequent(intervals: DataFrame, by: list[str], least: int, name: str) -> DataFrame:
    """Intervals of what is frequent in all shards together: ``f`` and the name ``id``; stored."""
    same = Window.partitionBy(*by)
    return store(
        intervals.withColumn("f", F.sum("n").over(same)).filter(F.col("f") >= least)
        .withColumn("id", F.min(_place("low")).over(same)),
        name,
    )


def _named(frequent: DataFrame) -> DataFrame:
    """One row for each name."""
    return frequent.filter(_place("low") == F.col("id")).drop("shard", "low", "n")


def _by_shard(frequent: DataFrame) -> DataFrame:
    """The intervals of a shard, at most as many as it has rows."""
    return (
        frequent.groupBy("shard")
        .agg(F.collect_list(F.struct("low", "n", "id")).alias("own"))
        .select("shard", F.col("own.low").alias("lows"), F.col("own.n").alias("lengths"), F.col("own.id").alias("names"))
    )


def _indexes(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """``shard, psi`` and the intervals of single words; stored."""
    joined = pieces.select("shard", "numbers", F.size("words").alias("size")).join(_by_shard(words), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, numbers, size, at, names in zip(*batch.columns, strict=True):
                of_word = np.full(size.as_py(), -1, np.int64)
                of_word[at.values.to_numpy()] = names.values.to_numpy()
                psi, named = index(unpacked(numbers.as_py()), of_word)
                rows = np.flatnonzero(named >= 0)
                new = np.ones(len(rows), bool)
                new[1:] = named[rows[1:]] != named[rows[:-1]]
                lows = rows[new]
                lengths = np.diff(np.append(np.flatnonzero(new), len(rows)))
                offsets = pa.array([0, len(lows)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()], pa.int64()), pa.array([packed(np.diff(psi, prepend=np.int32(0)))], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(lows.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(lengths.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(named[lows])),
                    ],
                    names=["shard", "psi", "lows", "lengths", "names"],
                )

    return store(
        joined.select("shard", "numbers", "size", "lows", "names").mapInArrow(
            run, "shard long, psi binary, lows array<int>, lengths array<int>, names array<long>"
        ),
        "phrase-indexes",
    )


def _scored(grams: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """``score, l, r`` of the lowest-scoring cut, of equal ones the first."""
    def score(left: str, right: str) -> str:
        return f"(cast(f as decimal(25,0)) * 2000000) div cast({left} + {right} as decimal(25,0))"

    options = ", ".join(
        f"named_struct('score', {score(left, right)}, 'k', {k}, 'l', {left}, 'r', {right})"
        for k, (left, right) in enumerate(cuts, 1)
    )
    return grams.withColumn("cut", F.expr(f"array_min(array({options}))"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = 80,
    text_col: str = "text", lang_col: str = "lang", size: int = SHARD,
) -> DataFrame:
    """The first ``top`` phrases of two to four words of each language.

    Returns ``lang, rank, phrase, a, l, r, n, score``: the phrase's occurrences, those of the
    two parts of its lowest-scoring cut, and all words of the language. A phrase is left out
    if a longer one that contains it has ``cover`` percent of its occurrences or more. Defined
    cases: a null language is ``und``; null, empty and blank texts and empty pieces have no
    words; repeated rows and ids count as often as they come; equal scores and counts go by
    the phrase's bytes; a language without frequent phrases has no row, an empty table none
    at all; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    pieces = shards(rows, size)
    totals = pieces.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    totals = totals.groupBy("lang").agg(F.sum("n").alias("n"))

    single = pieces.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("low", "w")).select(
        "shard", "low", F.col("w.counts").alias("n"), "lang", F.col("w.words").alias("text")
    )
    words = _frequent(single, ["lang", "text"], least, "phrase-words")
    indexed = _indexes(pieces, words)
    named = {1: store(_named(words), "phrases-1")}
    totals = store(totals, "phrase-totals")
    drop(pieces, words)
    state, done = indexed, []
    for n in range(2, DEPTH + 1):
        level = _frequent(_intervals(state), ["first", "last"], least, f"phrase-intervals-{n}")
        named[n] = store(_named(level), f"phrases-{n}")
        drop(*done)
        done = [level]
        if n < DEPTH:
            state = indexed.select("shard", "psi").join(_by_shard(level), "shard")

    drop(indexed, *done)

    # Texts, and the counts of the parts that a cut can leave: p_i the first, s_i the last i words.
    grams = {1: named[1].select("id", "lang", "text", "f", F.col("text").alias("tail"), F.col("f").alias("p1"), F.col("f").alias("s1"))}
    found = []
    for n in range(2, DEPTH + 1):
        parts = range(1, n)
        left, right = grams[n - 1], grams[n - 1]
        left = left.select(
            F.col("id").alias("first"), "lang", F.col("text").alias("head"), *[f"p{i}" for i in parts]
        )
        right = right.select(F.col("id").alias("last"), "tail", *[f"s{i}" for i in parts])
        grams[n] = store(
            named[n].join(left, "first").join(right, "last").select(
                "id", "first", "last", "lang", F.concat_ws(" ", "head", "tail").alias("text"), "f", "tail",
                *[f"p{i}" for i in parts], F.col("f").alias(f"p{n}"), *[f"s{i}" for i in parts], F.col("f").alias(f"s{n}"),
            ),
            f"phrase-texts-{n}",
        )
        scored = _scored(grams[n], [(f"p{k}", f"s{n - k}") for k in parts])
        found.append((n, scored.select("id", "lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "cut")))
    kept = None
    for n, candidates in found:
        if n < DEPTH:
            # No phrase of two words more is more frequent than the one between.
            longer = grams[n + 1].select(F.col("first").alias("id"), "f").union(grams[n + 1].select("last", "f"))
            longer = longer.groupBy("id").agg(F.max("f").alias("longer"))
            candidates = (
                candidates.join(longer, "id", "left")
                .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
            )
        kept = candidates if kept is None else kept.unionByName(candidates)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
