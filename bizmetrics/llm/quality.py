"""Quality rules: counts of a text, and bands of its n-gram perplexity by language.

The model is over the 4-grams of the texts' bytes as they are: case, digits, marks and other
scripts all count. It grows with the corpus, so it stays in Spark: texts are dealt to parts by
a hash, each part lists the 4-grams it has, these are counted over all parts, and each part is
sent the probabilities of its own. Probabilities are modified Kneser-Ney of all orders:
interpolated, with three discounts an order from the counts of counts, and continuation counts
below the top. Only the orders below the top are broadcast: at most 2**24 3-grams, as arrays
sorted by n-gram. Every text is scored twice: ``perplexity`` is that of the model of all rows,
the verdict that of a model of the distinct texts, so that copies move neither the model nor
the bands. For each language the middle of the distinct texts' log perplexities and their
median distance from it give the band outside which a text goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.llm.shared import drop, prepare, store
from bizmetrics.llm.text import Chunk, chunks, window_hashes, window_mask, word_bounds, word_hashes

BITS = 8
ORDER = 4
FLOOR = 1 / 64  # of a byte, below the unigrams; texts of a script have about so many bytes
PART = 32 << 20  # bytes of texts that share a part's n-grams, about
SMALL = 4 << 20  # of a part, where there are fewer than shuffle partitions
WIDTH = 8.0  # half width of a band in robust standard deviations
LEAST = 0.015  # least standard deviation of log perplexity, for small or uniform languages
FEW = 8  # distinct texts at which a language's own spread counts as much as the pooled one
ERROR = 1.17  # relative standard error of a median distance, times the root of the number
STEP = 1000  # log perplexities are rounded to 1 / STEP for the bands
_WORD, _TRIPLE, _LINE = 31, 32, 33
SYMBOLS = b"#*$%&|<>"


FOLD = np.arange(256, dtype=np.uint8) ^ 32  # symbol of each byte, one for one: a blank is 0


def grams(chunk: Chunk) -> np.ndarray:
    """The 4-gram that ends at each byte, as a number; blanks stand before a text."""
    n, pad = len(chunk.data), ORDER - 1
    symbols = np.zeros(n + pad * chunk.size, np.uint32)
    doc = np.repeat(np.arange(1, chunk.size + 1), np.diff(chunk.offsets))
    at = np.arange(n) + pad * doc
    symbols[at] = FOLD[chunk.data]
    keys = symbols[at]
    for k in range(1, ORDER):
        keys = keys | symbols[at - k] << np.uint32(BITS * k)
    return keys


class KneserNey:
    """Modified Kneser-Ney over n-grams as numbers; ``keys`` sorted, ``log_p`` beside.

    ``bits`` a symbol; ``floor`` is the probability of a symbol below the unigrams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = 6, order: int = 4, floor: float = 1 / 64):
        self.bits, self.order = bits, order
        by = np.argsort(keys)
        keys, counts = keys[by].astype(np.int64), counts[by].astype(np.float64)
        levels = [(keys, counts)]
        for k in range(order - 1, 0, -1):
            # Continuations: how many different symbols stand before the shorter n-gram.
            shorter, before = np.unique(levels[-1][0] & ((1 << bits * k) - 1), return_counts=True)
            levels.append((shorter, before.astype(np.float64)))
        lower = np.full(1, floor)
        for k, (own, n) in zip(range(1, order + 1), reversed(levels), strict=True):
            context, suffix = own >> bits, own & ((1 << bits * (k - 1)) - 1)
            size = 1 << bits * (k - 1)
            off = np.array(discounts([float((n == c).sum()) for c in (1, 2, 3, 4)]))[np.minimum(n, 3).astype(int)]
            total = np.bincount(context, n, size)
            freed = np.bincount(context, off, size)
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(total > 0, freed / total, 1.0)
            p = (n - off) / total[context] + back[context] * lower[suffix]
            if k < order:
                table = np.repeat(back, 1 << bits) * np.tile(lower, 1 << bits) if k > 1 else back[0] * np.full(1 << bits, floor)
                table[own] = p
                lower = table
        self.keys, self.log_p = own.astype(np.int32), np.log(p).astype(np.float32)
        with np.errstate(divide="ignore"):  # where no n-gram has been seen once, nothing is left for others
            self.back, self.lower = np.log(back).astype(np.float32), np.log(lower).astype(np.float32)

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """By binary search in the sorted hashes; else through the shorter n-gram."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.back[keys >> self.bits] + self.lower[keys & ((1 << self.bits * (self.order - 1)) - 1)]
        known = self.keys[at] == keys
        out[known] = self.log_p[at[known]]
        return out

    def score(self, keys: np.ndarray) -> np.ndarray:
        """The same for very many n-grams: each different one is searched once."""
        different, which = np.unique(keys, return_inverse=True)
        return self.log_prob(different)[which]


def discounts(of: list[float]) -> list[float]:
    """What is taken from counts of 0, 1, 2 and 3 or more; ``of`` are the numbers of n-grams
    that have a count of 1, 2, 3 and 4."""
    if not of[0]:
        return [0.0] * 4
    y = of[0] / (of[0] + 2 * of[1])
    out = [0.0]
    for c in (1, 2, 3):
        d = c - (c + 1) * y * of[c] / of[c - 1] if of[c - 1] else 0.0
        out.append(min(max(d, 0.1), c - 0.1))
    return out


def part_of(rows: DataFrame) -> tuple[Column, int]:
    """The part of a ``text``, from 0, and their number: it follows the texts' bytes.

    Parts are runs of the partitions that an exchange by ``text`` has, or shares of one: a task
    behind it holds few parts then. Nothing but the time hangs on that."""
    data = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(data // PART, min(spread, data // SMALL), 1)
    slot = f"pmod(hash(text), {spread})"
    if parts <= spread:
        return F.expr(f"cast({slot} * {parts}L div {spread} as int)"), parts
    shares = -(-parts // spread)
    return F.expr(f"cast({slot} * {shares} + pmod(xxhash64(text), {shares}) as int)"), shares * spread


def count_grams(texts: DataFrame, part: Column) -> DataFrame:
    """``part, gram, n, of_distinct`` of ``text``: counts over all rows, and over distinct texts
    alone. There may be several rows of one part and n-gram."""
    # Map tasks combine copies before the shuffle, so a text is sent once by each at most.
    once = texts.groupBy("text").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([known, *[k for k, _ in new]])
            n = np.concatenate([counts, *[n for _, n in new]], axis=1)
            new.clear()
            return _summed(keys, n)

        for batch in batches:
            copies, parts = (batch.column(i).to_numpy() for i in (1, 2))
            for chunk in chunks(batch.column(0)):
                own = slice(chunk.first, chunk.first + chunk.size)
                length = np.diff(chunk.offsets)
                keys = np.repeat(parts[own].astype(np.int64) << 32, length) | grams(chunk)
                different, n = np.unique(keys, return_counts=True)
                new.append((different, np.stack([n, n])))
                more = np.repeat(copies[own] - 1, length)
                if more.any():
                    new.append(_summed(keys[more > 0], np.stack([more[more > 0], np.zeros((more > 0).sum(), np.int64)])))
            if sum(len(k) for k, _ in new) > 1 << 20:
                known, counts = merged()
        known, counts = merged()
        for i in range(0, len(known), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array((known[part] >> 32).astype(np.int32)), pa.array(known[part].astype(np.uint32).view(np.int32)),
                 *[pa.array(n[part]) for n in counts]],
                names=["part", "gram", "n", "of_distinct"],
            )

    return once.mapInArrow(run, "part int, gram int, n long, of_distinct long")


MODELS = {"log_p": "n", "log_typical": "of_distinct"}  # and the counts they are made of


def probabilities(counted: DataFrame) -> DataFrame:
    """``gram, log_p, log_typical`` of every counted n-gram."""
    spark = counted.sparkSession
    counts = MODELS.values()
    whole = store(counted.groupBy("gram").agg(*[F.sum(n).alias(n) for n in counts]), "grams")
    # Continuation counts: 2**24 rows at most, whatever the corpus, and the same for both models.
    shorter = whole.groupBy(F.expr(f"gram & {(1 << BITS * (ORDER - 1)) - 1}").alias("gram")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).toArrow()
    if not shorter.num_rows:
        return whole.select("gram", *[F.lit(0.0).cast("float").alias(m) for m in MODELS])
    lower = spark.sparkContext.broadcast(
        KneserNey(shorter["gram"].to_numpy(), shorter["n"].to_numpy(), BITS, ORDER - 1, FLOOR)
    )
    tallies = whole.agg(*[F.expr(f"count_if({n} = {c})") for n in counts for c in (1, 2, 3, 4)]).first()
    # A context has 256 n-grams at most.
    context = Window.partitionBy(F.expr(f"shiftrightunsigned(gram, {BITS})"))
    own = [F.col("gram")]
    for i, n in enumerate(counts):
        off = discounts([float(t) for t in tallies[4 * i : 4 * i + 4]])
        seen = [F.sum(F.when(F.least(n, F.lit(3)) == c, 1).otherwise(0)).over(context) for c in (1, 2, 3)]
        freed = sum((off[c] * seen[c - 1] for c in (1, 2, 3)), F.lit(0.0))
        total = F.sum(n).over(context)
        left = F.col(n) - F.element_at(F.array(*[F.lit(d) for d in off[1:]]), F.least(n, F.lit(3)).cast("int"))
        own += [(left / total).alias(f"own_{n}"), (freed / total).alias(f"back_{n}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, *shares = (c.to_numpy() for c in batch.columns)
            suffix = gram & np.int32((1 << BITS * (ORDER - 1)) - 1)
            below = np.exp(lower.value.log_prob(suffix).astype(np.float64))
            logs = [np.log(own + back * below).astype(np.float32) for own, back in zip(shares[::2], shares[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in logs]], names=["gram", *MODELS])

    return whole.select(*own).mapInArrow(run, f"gram int, {', '.join(f'{m} float' for m in MODELS)}")


def packed(table: DataFrame) -> DataFrame:
    """``part, grams`` and a column a model, of ``part, gram`` and such: rows of one part become
    binary arrays, some for each part."""
    kinds = [np.int32, *[np.float32] * len(MODELS)]
    names = ["gram", *MODELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def arrays() -> Iterator[pa.RecordBatch]:
            part, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            by = np.argsort(part, kind="stable")
            part, columns = part[by], [c[by].astype(k) for c, k in zip(columns, kinds, strict=True)]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[a : a + 1]), *[pa.array([c[a:b].tobytes()]) for c in columns]], names=["part", *names]
                )

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield from arrays()
        if held:
            yield from arrays()

    return table.select("part", *names).mapInArrow(run, f"part int, {', '.join(f'{n} binary' for n in names)}")


class Scores:
    """Log probabilities of a part's n-grams, from what ``packed`` has made of them."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        def joined(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(v for p in pieces for v in p.column(name).to_pylist()), kind)

        keys = joined("gram", np.uint32)
        by = np.argsort(keys)
        self.keys, self.logs = keys[by], [joined(m, np.float32)[by] for m in MODELS]

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(0, np.float32) for _ in MODELS]
        different, which = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, different)
        if not len(self.keys) or at[-1] == len(self.keys) or (self.keys[at] != different).any():
            raise ValueError("an n-gram of a text has not been counted")
        return [own[at][which] for own in self.logs]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(which, n, len(keys)) for n in counts]).astype(np.int64)


def _per_doc(doc: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, size)[:size].astype(np.int64)


def rules(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of every document of a chunk."""
    size = chunk.size
    starts, ends, first = word_bounds(chunk)
    n_words = np.diff(first)
    byte_doc = np.repeat(np.arange(size), np.diff(chunk.offsets))

    # Code points in words: their bytes without the continuation bytes.
    lead = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=lead[1:])
    word_doc = np.repeat(np.arange(size), n_words)
    chars = _per_doc(word_doc, size, lead[ends] - lead[starts])

    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    symbols = _per_doc(byte_doc[marks[chunk.data]], size)

    # Lines with a word; a line's hash is of its bytes without the line feed.
    edges = np.unique(np.concatenate([chunk.offsets, np.flatnonzero(chunk.data == 10) + 1]))
    begin, end = edges[:-1], edges[1:].copy()
    end[chunk.data[end - 1] == 10] -= 1
    some = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[some], end[some]
    line_doc = np.searchsorted(chunk.offsets, begin, "right") - 1
    line = word_hashes(chunk, begin, end, _LINE)
    order = np.lexsort((line, line_doc))
    line, own = line[order], line_doc[order]
    again = (line[1:] == line[:-1]) & (own[1:] == own[:-1])
    dup_lines = _per_doc(own[1:][again], size)

    # Words covered by three-word windows that the text has twice or more.
    words = word_hashes(chunk, starts, ends, _WORD)
    at = np.flatnonzero(window_mask(first, 3, len(words)))
    triple = window_hashes(words, 3, _TRIPLE)[at]
    order = np.lexsort((triple, word_doc[at]))
    triple, own = triple[order], word_doc[at][order]
    same = (triple[1:] == triple[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at[order[twice]] + k] = True
    repeat = _per_doc(word_doc[covered], size)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols,
        "n_dup_lines": dup_lines, "n_repeat_words": repeat,
    }


def _bands(scored: DataFrame, width: float, least: float) -> DataFrame:
    """``lang, low, high`` from the distinct texts that pass the counts; a row a language.

    A spread is a mean of the language's own and the pooled one, weighted by its distinct
    texts and ``FEW``, and a standard error of it more, which is ``ERROR`` of it over the root
    of the texts: a band of few texts is wide. Pooled are the distances in languages of
    ``FEW`` distinct texts or more; if there is none, there are no bands.
    """

    def median(of: DataFrame, value: str, name: str, by: tuple[str, ...] = ("lang",)) -> DataFrame:
        run = Window.partitionBy(*by).orderBy(value)
        whole = Window.partitionBy(*by)
        # Of an even number the mean of the two in the middle, so that of two texts both stay.
        upper = F.min(F.when(F.expr("2 * upto > all"), F.col(value)))
        return (
            of.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
            .filter("2 * upto >= all").groupBy(*by)
            .agg(((F.min(value) + upper) / 2).alias(name), F.max("all").alias("texts"))
        )

    # At most as many rows as there are rounded values, for each language.
    steps = store(
        scored.filter("not base_failed")
        .select("lang", "t1", "t2", F.round(F.col("log_typical") * STEP).cast("long").alias("v")).distinct()
        .groupBy("lang", "v").agg(F.count(F.lit(1)).alias("n")),
        "log-perplexities",
    )
    middle = median(steps, "v", "middle")
    away = store(
        steps.join(middle, "lang").select("lang", F.abs(F.col("v") - F.col("middle")).alias("d"), "n", "texts")
        .groupBy("lang", "d").agg(F.sum("n").alias("n"), F.max("texts").alias("texts")),
        "distances",
    )
    spread = median(away.select("lang", "d", "n"), "d", "away").drop("texts")
    distances = away.filter(F.col("texts") >= FEW).groupBy("d").agg(F.sum("n").alias("n"), F.lit(0).alias("pool"))
    pooled = median(distances, "d", "pooled", ("pool",)).select("pooled")
    shrunk = (F.col("texts") * F.col("away") + FEW * F.col("pooled")) / (F.col("texts") + FEW)
    sigma = shrunk * (1 + ERROR / F.sqrt("texts")) * 1.4826 / STEP
    half = F.greatest(sigma, F.lit(least)) * width
    return middle.join(spread, "lang").crossJoin(F.broadcast(pooled)).select(
        "lang", (F.col("middle") / STEP - half).alias("low"), (F.col("middle") / STEP + half).alias("high")
    )


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    width: float = WIDTH, least: float = LEAST, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, perplexity and verdict of every text.

    Returns one row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, perplexity, kept`` and the ``carry`` columns. Defined cases:
    a null text has no words and fails; an empty text has no perplexity; a null language is
    a language of its own, and so is any other value; a language of which no text passes the
    counts has no band and rejects nothing more, nor does any if no language has ``FEW``
    distinct texts that pass; equal texts of a language get the same verdict; null and
    repeated ids and repeated rows are judged as they come; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    others = [c for c in carry if c != text_col]
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"),
        F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("none")]).alias("carried"),
    )
    part, parts = part_of(rows.select("text"))
    counted = store(count_grams(rows.select("text"), part), "part-grams")
    # One exchange brings a part's texts behind the probabilities of their n-grams.
    needed = store(packed(counted.select("part", "gram").distinct().join(probabilities(counted), "gram")), "part-models")
    drop(counted)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [*rows.columns[1:], *(["text"] if text_col in carry else [])]
    dealt = (
        rows.withColumn("part", part).withColumn("is_text", F.lit(True))
        .unionByName(needed.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
        .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_text", "t1", "t2")
    )

    def judged(batch: pa.RecordBatch, scores: Scores) -> pa.RecordBatch:
        one, two = (batch.column(n).to_numpy() for n in ("t1", "t2"))
        first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]  # copies follow each other
        found: list[list[np.ndarray]] = []
        for chunk in chunks(batch.column("text").filter(pa.array(first))):
            counts = rules(chunk)
            length = np.diff(chunk.offsets)
            logs = []
            for own in scores(grams(chunk)):
                total = np.zeros(len(chunk.data) + 1)
                np.cumsum(own, out=total[1:], dtype=np.float64)
                bits = total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs.append(-bits / length)
            found.append([*[counts[n] for n in names], *logs, length])
        of = np.cumsum(first) - 1
        *columns, length = (np.concatenate(c)[of] for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in kept], *[pa.array(c) for c in columns[: len(names)]],
             *[pa.array(c, mask=length == 0) for c in columns[len(names) :]]],
            names=[*kept, *names, *MODELS],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, scores = None, [], None
        for batch in batches:
            own, is_text = batch.column("part").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (is_text[1:] != is_text[:-1])]).tolist()
            for a, b in zip(edges, [*edges[1:], len(own)], strict=True):
                if a == b:
                    continue
                if own[a] != at:
                    at, pieces, scores = own[a], [], None
                if not is_text[a]:
                    pieces.append(batch.slice(a, b - a))
                    continue
                if scores is None:
                    scores, pieces = Scores(pieces), []
                yield judged(batch.slice(a, b - a), scores)

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    scored = store(
        dealt.mapInArrow(run, f"{kinds}, {', '.join(f'{n} long' for n in names)}, {', '.join(f'{m} double' for m in MODELS)}")
        .withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")),
        "scored",
    )
    drop(needed)
    bands = store(_bands(scored, width, least), "bands")
    inside = F.coalesce(F.col("log_typical").between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(bands, "lang", "left").select(
        "doc_id", *names, "base_failed", F.exp("log_p").alias("perplexity"),
        (~F.col("base_failed") & inside).alias("kept"),
        *[F.col("text" if c == text_col else f"carried.{c}").alias(c) for c in carry],
    )
