"""Ranked lexical search: dense blocks of document impacts times compact tiles of item terms.

One pass over the texts cuts them into terms and keeps, for each document, its length and the
terms that any item asks for, with their counts; that is stored. Spark counts documents, terms
and document frequencies from it. Then blocks of some hundred documents become dense float64
matrices over the vocabulary of one tile of items, and one matrix product gives the scores of
all pairs of the block and the tile. All entries are whole numbers and a tile's items are cut
so that no sum in a product can reach 2**53; sums beyond are added as 64-bit integers. So the
scores are exact whatever order BLAS adds in. A task keeps the best of each item, ties at the
edge by id, and Spark ranks the tasks' bests.

Items are a query set: their distinct terms, at most ``VOCABULARY`` for a pass, are
broadcast; more items are searched in several passes over the stored counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare, store
from bizmetrics.llm.text import chunks, word_bounds, word_hashes

TOP = 20
VOCABULARY = 1 << 18  # distinct terms of a pass, the bound of what is broadcast (some MB)
BLOCK = 256  # documents of a dense block
TILE_ITEMS = 32
TILE_TERMS = 1024  # distinct terms of a tile, but for a single item that has more
EXACT = 1 << 53
IMPACT = 1_000_000  # a term's frequency part stays below
_TERM, _CHECK = 61, 62
# Bytes that no term has: all ASCII but digits and letters.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_counts(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a lower-cased chunk: two hashes of each, its document, and terms a document."""
    starts, ends, first = word_bounds(chunk, GAP)
    sizes = np.diff(first)
    return (
        word_hashes(chunk, starts, ends, _TERM), word_hashes(chunk, starts, ends, _CHECK),
        np.repeat(np.arange(chunk.size), sizes), sizes,
    )


@dataclass
class Items:
    """Rows of the item table, their terms numbered by the sorted hashes of all terms."""

    terms: np.ndarray  # sorted hashes
    checks: np.ndarray  # second hashes beside them
    of_item: list[np.ndarray]  # term numbers of each item, with repeats

    def numbers(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Term number of each pair of hashes, -1 where no item has it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where((self.terms[at] == hashes) & (self.checks[at] == checks), at, -1)


def read_items(texts: pa.Array) -> Items:
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for chunk in chunks(texts, lower=True):
        hashes, checks, doc, _ = term_counts(chunk)
        parts.append((hashes, checks, doc + chunk.first))
    hashes, checks, item = (np.concatenate(c) for c in zip(*parts, strict=True))
    terms, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    bounds = np.searchsorted(item, np.arange(len(texts) + 1))
    return Items(terms, checks[first], [which[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


@dataclass
class Tile:
    """Some items and their own small vocabulary; ``repeats`` is terms by items."""

    items: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


def tiles(items: Items, weight: np.ndarray, most_items: int = TILE_ITEMS, most_terms: int = TILE_TERMS) -> list[Tile]:
    """Items that share terms beside each other, in tiles whose products stay below 2**53.

    An item whose own sum could reach that bound is spread over several tiles.
    """
    out: list[Tile] = []
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def close() -> None:
        if held:
            terms = np.unique(np.concatenate([t for _, t, _ in held]))
            repeats = np.zeros((len(terms), len(held)))
            for column, (_, own, n) in enumerate(held):
                repeats[np.searchsorted(terms, own), column] = n
            out.append(Tile(np.array([i for i, _, _ in held]), terms, repeats))
            held.clear()

    # Items with the same rare terms come together, so that tiles stay compact.
    rarest = [tuple(sorted(set(t.tolist()), key=lambda x: (-weight[x], x))[:4]) for t in items.of_item]
    vocabulary: set[int] = set()
    for i in sorted(range(len(items.of_item)), key=lambda i: (rarest[i], i)):
        terms, n = np.unique(items.of_item[i], return_counts=True)
        # Runs of terms whose largest possible sum is below the bound.
        largest = [int(k) * int(weight[t]) * IMPACT for t, k in zip(terms.tolist(), n.tolist(), strict=True)]
        cut, total = [0], 0
        for at, value in enumerate(largest):
            if value >= EXACT:
                raise ValueError("one term's repeats pass 2**53")
            if total + value >= EXACT:
                cut.append(at)
                total = 0
            total += value
        for a, b in zip(cut, [*cut[1:], len(terms)], strict=True):
            if a == b:
                continue
            own = set(terms[a:b].tolist())
            if held and (len(held) >= most_items or len(vocabulary | own) > most_terms or held[-1][0] == i):
                close()
                vocabulary = set()
            held.append((i, terms[a:b], n[a:b]))
            vocabulary |= own
    close()
    return out


class Best:
    """The ``top`` best documents of each item so far; equal scores by ascending id."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.rows = [np.zeros(0, np.int64)] * n_items
        self.floor = np.zeros(n_items, np.int64)

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` is documents by items; ``rows`` are the documents' numbers in id order.

        A score equal to the last kept one stays a candidate, as its id may be smaller.
        """
        some = (scores > 0) & (scores >= self.floor)
        for i in np.flatnonzero(some.any(axis=0)).tolist():
            own = np.flatnonzero(some[:, i])
            value = np.concatenate([self.scores[i], scores[own, i]])
            name = np.concatenate([self.rows[i], rows[own]])
            order = np.lexsort((name, -value))[: self.top]
            self.scores[i], self.rows[i] = value[order], name[order]
            if len(order) == self.top:
                self.floor[i] = value[order[-1]]


def postings(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, counts``: length in terms, and item terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                hashes, checks, doc, sizes = term_counts(chunk)
                number = known.numbers(hashes, checks)
                asked = number >= 0
                key, count = np.unique((doc[asked] << 32) | number[asked], return_counts=True)
                offsets = pa.array(np.searchsorted(key >> 32, np.arange(chunk.size + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(chunk.first, chunk.size), pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array((key & 0xFFFFFFFF).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def _search(rows: DataFrame, items: Items, n_docs: int, n_terms: int, df: np.ndarray, top: int) -> DataFrame:
    """``item, doc_id, score``: of every task the best documents of each item."""
    weight = np.array([int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))) for d in df.tolist()], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((tiles(items, weight), weight, len(items.of_item)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tiles, weights, n_items = shared.value
        best = Best(n_items, top)
        ids: pa.Array | None = None  # ids of the kept documents, then of the batch

        for batch in batches:
            kept = np.unique(np.concatenate(best.rows)) if ids is not None else np.zeros(0, np.int64)
            ids = batch.column(0) if ids is None else pa.concat_arrays([ids.take(pa.array(kept)), batch.column(0)])
            # Rows are named by the place of their id among these, so that names order as ids do.
            order = pc.array_sort_indices(ids, null_placement="at_end")
            place = np.empty(len(ids), np.int64)
            place[order.to_numpy()] = np.arange(len(ids))
            for i, old in enumerate(best.rows):
                best.rows[i] = place[np.searchsorted(kept, old)]
            ids = ids.take(order)
            names = place[len(kept) :]

            size = batch.num_rows
            lengths = batch.column(1).to_numpy()
            terms, counts = batch.column(2), batch.column(3)
            bounds = terms.offsets.to_numpy().astype(np.int64)
            number = terms.values.to_numpy()[bounds[0] : bounds[-1]]
            tf = counts.values.to_numpy()[counts.offsets[0].as_py() : counts.offsets[-1].as_py()].astype(np.int64)
            doc = np.repeat(np.arange(size), np.diff(bounds))
            m = 75 + 25 * lengths * n_docs // max(n_terms, 1)
            impact = (weights[number] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))).astype(np.float64)
            for at in range(0, size, BLOCK):
                stop = min(at + BLOCK, size)
                part = slice(*np.searchsorted(doc, [at, stop]))
                scores = np.zeros((stop - at, n_items), np.int64)
                for tile in own_tiles:
                    where = np.minimum(np.searchsorted(tile.terms, number[part]), len(tile.terms) - 1)
                    has = tile.terms[where] == number[part]
                    dense = np.zeros((stop - at, len(tile.terms)))
                    dense[doc[part][has] - at, where[has]] = impact[part][has]
                    scores[:, tile.items] += (dense @ tile.repeats).astype(np.int64)
                best.add(scores, names[at:stop])
        if ids is not None:
            which = np.repeat(np.arange(n_items), [len(r) for r in best.rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(which.astype(np.int32)),
                    ids.take(pa.array(np.concatenate([*best.rows, np.zeros(0, np.int64)]).astype(np.int64))),
                    pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]).astype(np.int64)),
                ],
                names=["item", "doc_id", "score"],
            )

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"item int, doc_id {kind}, score long")


def ranked(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", vocabulary: int = VOCABULARY,
) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
    lower-cased. Defined cases: a null or empty text, and one without terms, has none, counts
    for no statistic and is found by no item; an item without terms, or whose terms no document
    has, finds nothing; rows of ``docs`` that repeat an id, and rows that repeat, are documents
    of their own; rows of ``items`` that repeat an id are items of their own, each with its
    ranks; equal scores go by ascending id, a null id last; empty tables give an empty result;
    other columns are ignored, whatever their names. Items are the query set: their rows go
    through the driver (texts of some KB), ``vocabulary`` distinct terms at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    asked = items.select(F.col(item_text_col).alias("text"), F.col(item_col).alias("item_id")).toArrow().combine_chunks()
    texts, names = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in asked.columns)
    every = read_items(texts)
    # Passes of items with at most ``vocabulary`` distinct terms each, but for a single item.
    passes, held, terms = [], [], set()
    for i, own in enumerate(every.of_item):
        if held and len(terms.union(own.tolist())) > vocabulary:
            passes.append(held)
            held, terms = [], set()
        held.append(i)
        terms.update(own.tolist())
    passes.append(held)

    kind = items.schema[item_col].dataType.simpleString()
    found = []
    for some in passes:
        own = read_items(texts.take(pa.array(some, pa.int64())))
        rows = store(postings(docs, own, id_col, text_col), "postings")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(own.terms), np.int64)
        # A row for each term of the items at most.
        frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[frequency["term"].to_numpy()] = frequency["df"].to_numpy()
        named = spark.createDataFrame(
            pa.table({"item": pa.array(range(len(some)), pa.int32()), "item_id": names.take(pa.array(some, pa.int64()))}),
        )
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(
            _search(rows, own, total.docs, total.terms, df, top)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .join(named.select("item", F.col("item_id").cast(kind).alias("item_id")), "item")
            .select("item_id", "rank", "doc_id", "score")
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
