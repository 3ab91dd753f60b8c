"""Language of a text by a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of different byte n-grams (one to four bytes, a
blended spectrum) that both have, divided by the geometric mean of their own numbers.
``LANDMARKS`` labelled texts span the feature space: with K their kernel matrix, a text's
features are its kernels with them times K to the power -1/2. One ridge regression against
the rest for each language gives its weights. Both steps are linear in the text's n-gram
presences, so they are multiplied out once into a table with a row for each hashed n-gram,
and a batch of texts is scored by one product of presences and table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare
from bizmetrics.llm.text import LOWER, Chunk, chunks, mix, poly, window_hashes

NGRAMS = (1, 2, 3, 4)
BITS = 16  # hashed n-grams: 2**BITS
LANDMARKS = 240
SAMPLE = 3000  # labelled rows that are fitted, the bound of what reaches the driver
RIDGE = 1e-4
UNKNOWN = "und"


def presences(chunk: Chunk) -> np.ndarray:
    """Documents by hashed n-grams: whether the document has one."""
    data = LOWER[chunk.data]
    doc = np.repeat(np.arange(chunk.size), np.diff(chunk.offsets))
    out = np.zeros((chunk.size, 1 << BITS), bool)
    flat = out.ravel()
    values = poly(41).bytes[data]
    for n in NGRAMS:
        hashes = values if n == 1 else window_hashes(values, n, 41 + n)
        cells = (mix(hashes + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = doc[: len(cells)] == doc[n - 1 : n - 1 + len(cells)]
        flat[(doc[: len(cells)] << BITS)[inside] + cells[inside]] = True
    return out


def _pieces(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of at most 64 documents, so that presences stay at a few MB."""
    for chunk in chunks(column):
        for i in range(0, chunk.size, 64):
            offsets = chunk.offsets[i : i + 65]
            yield Chunk(chunk.first + i, chunk.data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed n-grams by languages
    bias: np.ndarray

    def scores(self, has: np.ndarray) -> np.ndarray:
        """One column a language; about 1 for the right one and 0 for the others."""
        size = np.sqrt(np.maximum(has.sum(1), 1))[:, None]
        return has.astype(np.float32) @ self.weights / size + self.bias


def fit(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a bounded sample (rows of packed presences); landmarks are taken in turn from
    the languages."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))

    def kernel_rows(rows: np.ndarray) -> np.ndarray:
        has = np.unpackbits(rows, axis=1).astype(np.float32)
        return has / np.sqrt(np.maximum(has.sum(1), 1))[:, None]

    seen = dict.fromkeys(languages, 0)
    turn = []
    for i, name in enumerate(labels):
        turn.append((seen[name], i))
        seen[name] += 1
    own = kernel_rows(packed[sorted(i for _, i in sorted(turn)[:landmarks])])
    values, vectors = np.linalg.eigh((own @ own.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    kernels = [kernel_rows(packed[i : i + 256]) @ own.T for i in range(0, len(packed), 256)]
    features = np.concatenate(kernels).astype(np.float64) @ root
    target = np.array([[float(name == other) for other in languages] for name in labels])
    # Every language counts as much as the others, however many rows it has.
    weight = np.array([len(labels) / len(languages) / seen[name] for name in labels])[:, None]
    middle = (features * weight).sum(0) / weight.sum()
    mean = (target * weight).sum(0) / weight.sum()
    centred = features - middle
    gram = centred.T @ (centred * weight) + ridge * weight.sum() * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, centred.T @ ((target - mean) * weight))
    return Model(languages, (own.T @ (root @ beta)).astype(np.float32), mean - middle @ beta)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``id, text, lang``: those with the least hashes, one
    of equal rows. The whole texts count, as presences packed to bits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                bits = np.packbits(presences(piece), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.tobytes() for row in bits], pa.binary()),
                     *[batch.column(i).slice(piece.first, piece.size) for i in (1, 2)]],
                    names=["bits", "lang", "h"],
                )

    hashed = labelled.select("text", "lang", F.xxhash64("id", "text", "lang").alias("h"))
    # The largest hash of the sample, from hashes alone: texts are not sorted or shuffled.
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = (
        hashed.filter(F.col("h") <= (0 if last is None else last))
        .mapInArrow(pack, "bits binary, lang string, h long")
        .dropDuplicates(["h"])
        .toArrow().sort_by("h")
    )
    data = b"".join(chosen["bits"].to_pylist())
    packed = np.frombuffer(data, np.uint8).reshape(-1, (1 << BITS) // 8)
    return fit(packed, chosen["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text alone.

    ``score`` is the best language's regression value within 0 to 1. Defined cases: a null
    text, one without a letter, and any text if no language was learned, are ``und`` with
    score 0; null and repeated ids and repeated rows are predicted as they come; equal scores
    go to the first language in order; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for piece in _pieces(batch.column(0)):
                known = letters[piece.first : piece.first + piece.size] & bool(model.languages)
                names, best = [UNKNOWN] * piece.size, np.zeros(piece.size)
                if known.any():
                    scores = model.scores(presences(piece))
                    top = scores.argmax(1)
                    best = np.where(known, np.clip(scores.max(1), 0, 1), 0.0)
                    names = [model.languages[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(piece.first, piece.size), pa.array(names), pa.array(best.astype(np.float64))],
                    names=["doc_id", "lang_pred", "score"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """Whether a row's label is kept from training: by the checksum of its id as text."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out; predict all:
    ``doc_id, held_out, lang_pred, score``."""
    prepare(docs.sparkSession)
    model = train(
        docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select(F.col("doc_id").alias("id"), "text", "lang"),
        sample,
    )
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
