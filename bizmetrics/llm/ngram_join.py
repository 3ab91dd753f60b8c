"""Exact Jaccard join of n-gram sets that skips by the relations between the sets.

Sets are ordered by a global order of shingles (rare ones first, by a merged count-min
sketch; then by hash). Two sets that link share a shingle within the first
``n - ceil(t n) + 1`` of each, so an index list per such shingle holds all candidates.

* Equal sets are one set: the index only sees one of them.
* Within a list, each set first only meets the list's head (its least id). Sets that
  link with a head belong to its *block*, with their distance to it: of n near copies in a
  list that is n meetings, not n * n. Further rounds draw other heads for the sets that are
  in another component than theirs.
* A meeting costs two shingle sets only if the sets' signatures (parities of hashed shingles,
  a lower bound of their difference) allow a link: most sets meet by chance.
* Then blocks of different components meet, not sets. In every list a block is one entry
  with the range of its sizes and the longest rest behind its positions; a pair of entries
  is skipped if no sizes and positions in them could give the overlap, and if the heads'
  signatures are too far apart for their radii.
* The members' answers are derived from those of the heads. Distance is a metric: if the
  heads of two blocks are further apart than the threshold and both distances to the heads
  together, no members link. If the heads link, the blocks are one component, and no member
  needs to be compared. Only what lies between is compared set by set, each pair by the same
  bound from its own two distances.

All shuffles are by shingle, set or block. A shingle that the sketch finds in more than
``HOT`` sets has its list split into as many parts by set; the parts' heads then meet as
blocks. No pairs are emitted within a block, and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm import sketch
from bizmetrics.llm.links import components, extended
from bizmetrics.llm.shared import drop, prepare, store
from bizmetrics.llm.text import chunks, mix, poly, window_hashes, word_bounds, word_hashes

SKETCH = sketch.Shape(bits=22, rows=1, limit=(1 << 16) - 1)  # 8 MB
WANTED = sketch.Shape(bits=22, rows=2, limit=255)
SIGNATURE = 8  # long integers
SIGNED = [f"s{i}" for i in range(SIGNATURE)]
DIFFER = "(" + " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in SIGNED) + ")"
HOT = 5000
OFTEN = 0.02  # links a meeting, from which another round of heads is worth its while
_WORD, _SHINGLE, _SHORT, _DIGEST = 21, 22, 23, 24


@dataclass(frozen=True)
class Similarity:
    """Link if den * intersection >= num * union, for sets of ``words``-word shingles."""

    words: int = 3
    num: int = 90
    den: int = 100
    lower: bool = True

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of the first shingles of a set of n every link must touch."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, n: str, m: str) -> str:
        """SQL: the least intersection with which sets of n and m link."""
        return f"(({self.num} * ({n} + {m}) + {self.num + self.den - 1}) div {self.num + self.den})"

    @property
    def most(self) -> float:
        """The largest distance (1 - similarity) of sets that link, and a little more."""
        return 1 - self.num / self.den + 1e-9

    def sizes(self, n: str, m: str) -> str:
        """SQL: neither size is too large for the other."""
        return f"({self.den} * {n} >= {self.num} * {m} and {self.den} * {m} >= {self.num} * {n})"


def shingle_sets(column: pa.Array, how: Similarity) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: first row, shingles of all its documents (distinct, sorted within a
    document) and the bounds of each document's."""
    for chunk in chunks(column, lower=how.lower):
        starts, ends, first = word_bounds(chunk)
        words = word_hashes(chunk, starts, ends, _WORD)
        counts = np.diff(first)
        number = np.where(counts >= how.words, counts - how.words + 1, (counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(chunk.size), number)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[doc]
        windows = window_hashes(words, how.words, _SHINGLE)
        short = counts[doc] < how.words
        hashes = np.empty(len(doc), np.uint64)
        hashes[~short] = windows[at[~short]]
        # The whole sequence of a document with fewer words.
        hashes[short] = poly(_SHORT).runs(words, at[short], first[doc[short] + 1])
        order = np.lexsort((hashes, doc))
        hashes = hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        yield chunk.first, hashes[new], np.searchsorted(doc[new], np.arange(chunk.size + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set, whatever the order of its elements."""
    high = _sums(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
    low = _sums(mix(mix(shingles) + np.uint64(_DIGEST)), bounds)
    return high.view(np.int64), low.view(np.int64)


def _parities(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``SIGNATURE`` numbers for each set: the parity of its shingles in each of
    64 * SIGNATURE cells. Two sets differ in at least as many shingles as parities."""
    size, cells = len(bounds) - 1, 64 * SIGNATURE
    doc = np.repeat(np.arange(size), np.diff(bounds))
    cell = (shingles >> np.uint64(32)).astype(np.int64) % cells
    odd = np.bincount(doc * cells + cell, minlength=size * cells).reshape(size, cells) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(">i8").astype(np.int64).reshape(size, SIGNATURE)


def _indexed(rows: DataFrame, how: Similarity, shape: sketch.Shape, hot: int) -> DataFrame:
    """``doc_id, fp, n, d1, d2, prefix, parts`` and the signature: size, digest, first shingles
    in the global order and into how many parts each one's list is split; stored with a
    ``rid``."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, shingles, _ in shingle_sets(batch.column(0), how):
            yield shingles

    table = sketch.count(rows.select("text"), keys, shape)
    # What a cell holds of other shingles on average counts for no list.
    noise = int(table[: 1 << shape.bits].sum() >> shape.bits)
    counts = rows.sparkSession.sparkContext.broadcast(table)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shingles, bounds in shingle_sets(batch.column(0), how):
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)
                seen = sketch.estimate(counts.value, shape, shingles).astype(np.int64)
                order = np.lexsort((shingles, seen, doc))
                rank = np.arange(len(doc)) - bounds[doc]
                take = np.where(size > 0, how.prefix(size), 0)
                chosen = order[rank < take[doc]]
                parts = np.maximum(seen[chosen] - noise, 0) // hot + 1
                d1, d2 = _digests(shingles, bounds)
                offsets = pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, len(size)), batch.column(2).slice(first, len(size)),
                        pa.array(size.astype(np.int64)), pa.array(d1), pa.array(d2),
                        pa.ListArray.from_arrays(offsets, pa.array(shingles[chosen].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(parts.astype(np.int32))),
                        *[pa.array(np.ascontiguousarray(c)) for c in _parities(shingles, bounds).T],
                    ],
                    names=["doc_id", "fp", "n", "d1", "d2", "prefix", "parts", *SIGNED],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(
        index,
        f"doc_id {kind}, fp long, n long, d1 long, d2 long, prefix array<long>, parts array<int>, "
        + ", ".join(f"{c} long" for c in SIGNED),
    )
    return store(made.withColumn("rid", F.monotonically_increasing_id()), "sets")


def _matched(run: np.ndarray, n: np.ndarray, rest: np.ndarray, how: Similarity) -> np.ndarray:
    """Whether an entry's list has another one of a size that allows a link; in a list of
    two, also whether their positions do. ``run`` numbers the lists, sorted."""
    order = np.lexsort((n, run))
    by, size = run[order], n[order]
    near = (by[1:] == by[:-1]) & (how.den * size[:-1] >= how.num * size[1:])
    length = np.bincount(run)
    both = length[by[1:]] == 2
    left = np.minimum(rest[order][1:], rest[order][:-1])
    needed = -(-how.num * (size[1:] + size[:-1]) // (how.num + how.den))
    near &= ~both | (left >= needed)
    out = np.zeros(len(run), bool)
    out[order[1:]] |= near
    out[order[:-1]] |= near
    return out


def _lists(how: Similarity):
    """Entries sorted by shingle, part and id -> the same with the list's head, without
    entries that no other entry of the list can link with (lists that are split or that go
    on in another batch stay whole)."""
    names = ["shingle", "part", "split", "id", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, sent = None, True
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            extra = carried is not None
            if extra:
                columns = [np.concatenate([[h], c]) for h, c in zip(carried, columns, strict=True)]
            shingle, part, split, _, n, pos = columns
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
            number = np.cumsum(new) - 1
            head = np.flatnonzero(new)[number]
            keep = ~new
            keep[:-1] |= new[:-1] & ~new[1:]
            # What is known to the end: not the first list if it goes on, not the last one.
            whole = (number > 0) | (not extra)
            whole &= number < number[-1]
            keep &= ~whole | _matched(number, n, n - pos, how)
            keep |= split.astype(bool)
            if extra and sent:
                keep[0] = False
            last = int(head[-1])
            # The last list may go on: its head is carried, as sent or not yet sent.
            was = sent and extra and last == 0
            sent = bool(keep[last]) or was
            carried = [c[last] for c in columns]
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at]) for c in (shingle, *columns[3:])] + [pa.array(c[head[at]]) for c in columns[3:]],
                names=["shingle", *names[3:], "head", "head_n", "head_pos"],
            )

    return run


def _possible(pairs: DataFrame, signed: DataFrame, how: Similarity) -> DataFrame:
    """The ``pairs`` (a, b, n, m) whose signatures allow a link."""
    x = signed.select(F.col("id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in SIGNED])
    y = signed.select(F.col("id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in SIGNED])
    both = pairs.join(x, "a").join(y, "b")
    return both.filter(f"2 * {DIFFER} <= {how.most} * (n + m + {DIFFER})").select(*pairs.columns)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``common``: the size of the intersection."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long")).drop("sa", "sb")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _sets(rows: DataFrame, of_set: DataFrame, ids: DataFrame, how: Similarity) -> DataFrame:
    """``id, shingles`` of some sets, from the texts again; stored.

    A sketch of the wanted documents' ids, of fixed size, keeps most other texts from being
    cut into shingles; digests decide. Rows that repeat id and text may give a set twice.
    """
    wanted = store(ids.join(of_set, "id").select("id", F.xxhash64("of").alias("k"), "d1", "d2"), "wanted")

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(np.uint64)

    some = rows.sparkSession.sparkContext.broadcast(sketch.AtLeast(wanted.select("k"), keys, WANTED, 1))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = some.value(batch.column(1).to_numpy().view(np.uint64))
            for _, shingles, bounds in shingle_sets(batch.column(0).filter(pa.array(own)), how):
                d1, d2 = _digests(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d1), pa.array(d2),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64))),
                    ],
                    names=["d1", "d2", "shingles"],
                )

    found = rows.select("text", F.xxhash64("doc_id").alias("k")).mapInArrow(
        full, "d1 long, d2 long, shingles array<long>"
    )
    out = store(found.join(wanted.select("id", "d1", "d2"), ["d1", "d2"]).select("id", "shingles"), "shingles")
    drop(wanted)
    return out


def _compared(pairs: DataFrame, rows: DataFrame, of_set: DataFrame, how: Similarity) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) with ``common``, and the sets made for them, to be dropped when read.

    Only the sets of these pairs: those of earlier pairs would be dealt out again each time.
    """
    if pairs.isEmpty():
        return pairs.withColumn("common", F.lit(0).cast("long")), pairs
    sets = _sets(rows, of_set, _ids(pairs), how)
    return _overlaps(pairs, sets), sets


def _rooted(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """``ids`` with the root of each id, its own where nothing links to it."""
    return ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def ngram_links(
    docs: DataFrame, how: Similarity, id_col: str = "doc_id", text_col: str = "text",
    shape: sketch.Shape = SKETCH, hot: int = HOT, detail: bool = False,
) -> DataFrame:
    """Component of every document under links between similar shingle sets.

    Returns one row per input row: ``doc_id, n_shingles, component_id``, with ``detail`` also
    ``fp``, a hash of the text, and ``root``, which names the component whatever its ids (null
    without shingles). Defined cases: a
    null or blank text has no shingles and links with nothing, so its component is its own
    id; a text with fewer words than a shingle has the whole sequence as its only one; rows
    that repeat an id count as documents of their own with that id; a null id is never the
    least id of a component that has another; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("fp")
    )
    indexed = _indexed(rows, how, shape, hot)

    # One row for equal sets; its rid is the set's id.
    of_set = store(
        indexed.filter("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("rid", "doc_id")).alias("one"), F.min("doc_id").alias("least"))
        .select("d1", "d2", F.col("one.rid").alias("id"), F.col("one.doc_id").alias("of"), "least"),
        "distinct-sets",
    )
    entries = (
        indexed.join(of_set.select(F.col("id").alias("rid")), "rid", "left_semi")
        .select("rid", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "e"))
        .select(
            F.col("e.prefix").alias("shingle"),
            F.pmod(F.xxhash64("rid"), F.col("e.parts")).cast("int").alias("part"),
            (F.col("e.parts") > 1).cast("int").alias("split"),
            F.col("rid").alias("id"), "n", F.col("pos").cast("long").alias("pos"),
        )
    )
    live = store(
        entries.repartition("shingle", "part")
        .sortWithinPartitions("shingle", "part", "id")
        .mapInArrow(
            _lists(how),
            "shingle long, id long, n long, pos long, head long, head_n long, head_pos long",
        ),
        "lists",
    )
    # The first shingles, hashes that nothing packs, are in the lists now.
    wide, indexed = indexed, store(indexed.drop("prefix", "parts"), "signed-sets")
    drop(wide)

    # Every set meets the heads of its lists; the least head it links with is its block.
    enough = how.overlap("n", "m")
    meet = f"{how.sizes('n', 'm')} and least(rest, head_rest) >= {enough}"
    signatures = indexed.select(F.col("rid").alias("id"), *SIGNED)
    met = (
        live.select(
            F.col("id").alias("a"), F.col("head").alias("b"), "n", F.col("head_n").alias("m"),
            (F.col("n") - F.col("pos")).alias("rest"), (F.col("head_n") - F.col("head_pos")).alias("head_rest"),
        )
        .filter(f"a <> b and {meet}").select("a", "b", "n", "m").distinct()
    )
    met = store(_possible(met, signatures, how), "met")
    compared, sets = _compared(met, rows, of_set, how)
    stars = store(
        compared
        .filter(f"common >= {enough}")
        .groupBy("a")
        .agg(F.min(F.struct("b", (1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("far"))).alias("s"))
        .select("a", F.col("s.b").alias("b"), F.col("s.far").alias("far")),
        "stars",
    )
    drop(met, sets)
    roots = components(stars.select("a", "b"))
    lists = live.select("shingle", "id", "n", (F.col("n") - F.col("pos")).alias("rest"))

    # Then other heads, drawn for each list and round, as long as meetings often give links:
    # what becomes one component need not be compared below.
    draw = 0
    while True:
        draw += 1
        now = store(_rooted(lists, roots), "rooted")
        heads = store(
            now.groupBy("shingle")
            .agg(
                F.min(F.struct(F.xxhash64("id", "shingle", F.lit(draw)), "id", "n", "rest", "root")).alias("h"),
                F.min("root").alias("r0"), F.max("root").alias("r1"),
            )
            .filter("r0 < r1")
            .select(
                "shingle", F.col("h.id").alias("b"), F.col("h.n").alias("m"),
                F.col("h.rest").alias("head_rest"), F.col("h.root").alias("head_root"),
            ),
            "heads-drawn",
        )
        met = store(
            now.join(heads, "shingle").filter(f"root <> head_root and {meet}")
            .select(F.col("id").alias("a"), "b", "n", "m").distinct(),
            "met",
        )
        near = store(_possible(met, signatures, how), "met-near")
        compared, sets = _compared(near, rows, of_set, how)
        new = store(compared.filter(f"common >= {enough}").select("a", "b"), "links-drawn")
        won, tried = new.count(), met.count()
        drop(now, heads, met, near, sets)
        if won:
            roots = extended(roots, new)
        if won <= OFTEN * tried:
            break

    member = store(
        _rooted(live.select("id", "n").distinct(), roots)
        .join(stars.select(F.col("a").alias("id"), F.col("b").alias("block"), "far"), "id", "left")
        .select("id", "n", "root", F.coalesce("block", "id").alias("block"), F.coalesce("far", F.lit(0.0)).alias("far")),
        "members",
    )
    head = indexed.select(F.col("rid").alias("block"), F.col("n").alias("size"), *SIGNED)
    blocks = store(
        member.groupBy("block").agg(F.max("far").alias("radius")).join(head, "block"), "blocks"
    )
    placed = store(lists.drop("n").join(member, "id"), "placed")
    # Blocks of different components meet in lists: each with the range of its sizes, its
    # longest rest, and the size and signature of its head.
    open_ = placed.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    placed_open = store(placed.join(store(open_.select("shingle"), "lists-open"), "shingle", "left_semi"), "placed-open")
    summary = store(
        placed_open.groupBy("shingle", "root", "block")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
        .join(blocks, "block"),
        "blocks-in-lists",
    )

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "shingle"])

    most, differ = how.most, DIFFER
    meeting = store(
        side(summary, "x").join(side(summary, "y"), "shingle")
        .filter(
            f"x_block < y_block and x_root <> y_root "
            f"and {how.den} * x_high >= {how.num} * y_low and {how.den} * y_high >= {how.num} * x_low "
            f"and least(x_rest, y_rest) >= {how.overlap('x_low', 'y_low')} "
            f"and 2 * {differ} <= ({most} + x_radius + y_radius) * (x_size + y_size + {differ})"
        )
        .select(F.col("x_block").alias("a"), F.col("y_block").alias("b"))
        .distinct(),
        "meeting",
    )
    drop(placed, placed_open, summary)
    heads = (
        meeting.join(blocks.select(F.col("block").alias("a"), F.col("size").alias("n"), F.col("radius").alias("ra")), "a")
        .join(blocks.select(F.col("block").alias("b"), F.col("size").alias("m"), F.col("radius").alias("rb")), "b")
    )
    heads = store(heads, "heads-met")
    compared, sets = _compared(heads, rows, of_set, how)
    heads = store(
        compared
        .withColumn("link", F.expr(f"common >= {enough}"))
        .withColumn("apart", 1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))),
        "heads",
    )
    drop(meeting, sets)
    links = heads.filter("link").select("a", "b")

    # Between the bounds: members meet, each pair only if its own distances and signatures
    # allow a link.
    unsure = heads.filter(f"not link and apart <= {most} + ra + rb and ra + rb > 0").select("a", "b", "apart", "ra", "rb")
    if not unsure.isEmpty():
        back = unsure.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart", F.col("rb").alias("ra"), F.col("ra").alias("rb"))
        other = blocks.select(F.col("block").alias("b"), F.col("size").alias("y_size"), *[F.col(c).alias(f"y_{c}") for c in SIGNED])
        unsure = store(unsure.union(back).join(other, "b"), "unsure")
        signed = store(member.join(signatures, "id"), "signed")
        x, y = ([F.col(c).alias(f"{name}_{c}") for c in signed.columns] for name in "xy")
        # A member near enough to the other head, then members near enough to each other.
        towards = store(
            signed.select(*x).join(unsure, F.col("x_block") == F.col("a"))
            .filter(
                f"apart <= {most} + x_far + rb "
                f"and 2 * {differ} <= ({most} + rb) * (x_n + y_size + {differ})"
            )
            .drop("a", "y_size", *[f"y_{c}" for c in SIGNED]),
            "towards",
        )
        near = store(
            towards.join(signed.select(*y), F.col("y_block") == F.col("b"))
            .filter(
                f"x_id < y_id and x_root <> y_root and apart <= {most} + x_far + y_far "
                f"and {how.sizes('x_n', 'y_n')} and 2 * {differ} <= {most} * (x_n + y_n + {differ})"
            )
            .select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.col("x_n").alias("n"), F.col("y_n").alias("m"))
            .distinct(),
            "near",
        )
        compared, _ = _compared(near, rows, of_set, how)
        links = links.union(compared.filter(f"common >= {enough}").select("a", "b"))
    roots = extended(roots, links)
    named = (
        of_set.select("d1", "d2", "id", "least")
        .join(roots, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("d1", "d2", "component_id", "root")
    return (
        indexed.select("doc_id", "fp", "n", "d1", "d2")
        .join(named, ["d1", "d2"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            *(["fp", "root"] if detail else []),
        )
    )
