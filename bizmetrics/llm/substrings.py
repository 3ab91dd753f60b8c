"""Repeated passages: windows of words that also start in a document with a smaller id.

A count-min sketch is the prefilter. Each window is counted through its anchor, the short
word sequence in it with the least hash: equal windows have equal anchors, so the count of
the anchor is never below that of the window, and neighbouring windows share anchors, which
makes the sketch some twenty times less loaded. The partitions' sketches are merged into
one of fixed size; windows whose estimate is below two can't repeat and are done. The
others are grouped exactly, by 128 bits of hash and the smallest id, combined before the
shuffle; the windows of a larger id are joined back and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm import sketch
from bizmetrics.llm.shared import drop, prepare, store
from bizmetrics.llm.text import Chunk, chunks, window_hashes, window_mask, word_bounds, word_hashes

WINDOW = 50
ANCHOR = 8
SKETCH = sketch.Shape(bits=25, rows=2, limit=255)
_WORD, _FIRST, _SECOND, _ANCHOR, _OTHER = 11, 12, 13, 14, 15


def _anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` gram hashes the least one, by doubling."""
    least, width = grams, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def _windows(chunk: Chunk, window: int, anchor: int):
    """Word bounds and hashes, and mask, document and anchor of each window of a chunk."""
    starts, ends, first = word_bounds(chunk)
    words = word_hashes(chunk, starts, ends, _WORD)
    inside = window_mask(first, window, len(words))
    doc = np.repeat(np.arange(chunk.size), np.diff(first))[: len(inside)]
    grams = window_hashes(words, anchor, _ANCHOR)
    least = _anchors(grams, window - anchor + 1) if len(inside) else grams[:0]
    return (starts, ends), words, inside, doc, least


def _sketch(docs: DataFrame, window: int, anchor: int, shape: sketch.Shape) -> sketch.AtLeast:
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in chunks(batch.column(0)):
            _, _, inside, doc, least = _windows(chunk, window, anchor)
            doc, least = doc[inside], least[inside]
            # An anchor counts once a run of windows: more than once a document at most
            # overestimates.
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            yield least[new]

    return sketch.AtLeast(docs.select("text"), keys, shape, 2)


def _candidates(rows: DataFrame, repeated, window: int, anchor: int) -> DataFrame:
    """Windows whose estimate is two or more: ``h1, h2, doc_id, fp, start``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(1), batch.column(2)
            for chunk in chunks(batch.column(0)):
                bounds, words, inside, doc, least = _windows(chunk, window, anchor)
                at = np.flatnonzero(inside)
                at = at[repeated.value(least[at])]
                if not len(at):
                    continue
                first = np.searchsorted(doc, np.arange(chunk.size))
                # The second half of the 128 bits has word hashes of its own.
                other = word_hashes(chunk, *bounds, _OTHER)
                rows = pa.array(chunk.first + doc[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(window_hashes(words, window, _FIRST)[at].view(np.int64)),
                        pa.array(window_hashes(other, window, _SECOND)[at].view(np.int64)),
                        ids.take(rows),
                        prints.take(rows),
                        pa.array((at - first[doc[at]]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "fp", "start"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.filter("doc_id is not null").select("text", "doc_id", "fp")
    return known.mapInArrow(find, f"h1 long, h2 long, doc_id {kind}, fp long, start int")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, anchor: int = ANCHOR, shape: sketch.Shape = SKETCH,
) -> DataFrame:
    """Starts (word numbers) of the windows of each document that a smaller id also has.

    Returns ``doc_id, fp, starts`` with ``fp = xxhash64(text)``, only for documents that have
    any; see ``remove_repeated`` for the defined cases.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("fp")
    )
    repeated = spark.sparkContext.broadcast(_sketch(rows, window, anchor, shape))
    found = _candidates(rows, repeated, window, anchor)
    # Stored, so that the join has an exchange on both sides and can split a hot window.
    first = store(
        found.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("h1", "h2", "first"),
        "first-windows",
    )
    # Stored as well: the windows' shuffle files can go before the texts are dealt out.
    spans = store(
        found.join(first, ["h1", "h2"])
        .filter("doc_id > first")
        .groupBy("doc_id", "fp")
        .agg(F.collect_set("start").alias("starts")),
        "repeated-spans",
    )
    drop(first)
    return spans


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, anchor: int = ANCHOR, shape: sketch.Shape = SKETCH,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Remove the words that lie in a window which also starts in a document of smaller id.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage
    return. Windows are judged on the input. Returns one row per input row: ``doc_id,
    n_words, n_removed, kept_sha256, kept_text`` (kept words joined by a space; the text
    itself, unchanged, where nothing is removed and ``kept_sha256`` is of the joined words)
    and the ``carry`` columns. Defined cases: a null text has no words; a row without id
    neither removes nor loses words; rows that repeat an id are one document, of which none
    removes words of the other; texts shorter than the window keep all; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("fp"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
    )
    spans = repeated_spans(docs, id_col, text_col, window, anchor, shape)
    joined = rows.join(spans, ["doc_id", "fp"], "left").select("text", "starts", "doc_id", "carried")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, shas, kept = [], [], [], []
            starts = batch.column(1)
            for chunk in chunks(batch.column(0)):
                begin, end, first = word_bounds(chunk)
                for i in range(chunk.size):
                    own = slice(first[i], first[i + 1])
                    n = int(first[i + 1] - first[i])
                    cover = np.zeros(n + 1, np.int64)
                    at = starts[chunk.first + i]
                    if at.is_valid:
                        at = at.values.to_numpy()
                        cover[at] += 1
                        cover[at + window] -= 1
                    keep = np.cumsum(cover[:n]) == 0
                    text = chunk.text(i)
                    joined = b" ".join(
                        text[s:e]
                        for s, e in zip(
                            (begin[own][keep] - chunk.offsets[i]).tolist(),
                            (end[own][keep] - chunk.offsets[i]).tolist(),
                            strict=True,
                        )
                    )
                    removed = n - int(keep.sum())
                    n_words.append(n)
                    n_removed.append(removed)
                    shas.append(hashlib.sha256(joined).hexdigest())
                    kept.append((joined if removed else text).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(kept, pa.string()),
                    batch.column(3),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "carried"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    out = joined.mapInArrow(
        remove,
        f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_sha256 string, "
        f"kept_text string, carried {kinds['carried']}",
    )
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text",
                      *[F.col(f"carried.{c}").alias(c) for c in carry])
