"""What the operators deal out and store: only what the next step needs."""

from __future__ import annotations

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizmetrics.llm import exact, links, ngram_join, phrases, shared, sketch, substrings

HOW = ngram_join.Similarity(3, 90, 100)


def _words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def _chance_and_copies(spark):
    """Ten texts that share only a passage of four words, and a pair of near copies."""
    rng = random.Random(5)
    shared = _words(rng, 4)
    texts = [" ".join(shared + _words(rng, 60)) for _ in range(10)]
    base = _words(rng, 60)
    texts += [" ".join(base), " ".join(base + ["more"])]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sets_that_meet_by_chance_are_not_fetched(spark, monkeypatch):
    fetched = []
    sets = ngram_join._sets

    def watched(rows, of_set, ids, how):
        fetched.extend(r.of for r in ids.join(of_set, "id").select("of").collect())
        return sets(rows, of_set, ids, how)

    monkeypatch.setattr(ngram_join, "_sets", watched)
    out = {r.doc_id: r.component_id for r in ngram_join.ngram_links(_chance_and_copies(spark), HOW).collect()}
    assert out == {i: i for i in range(11)} | {11: 10}
    assert set(fetched) == {10, 11}


def test_signatures_keep_every_link(spark):
    """Random sets at and around the threshold: no pair that links is dropped."""
    rng = np.random.default_rng(3)
    sets, pairs = [], []
    for k in range(60):
        base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        other = np.concatenate([base[: 200 - k], rng.integers(0, 1 << 63, k // 2, dtype=np.uint64)])
        sets += [np.sort(base), np.sort(other)]
        common = len(np.intersect1d(base, other))
        pairs.append((2 * k, 2 * k + 1, 200, len(other), bool(100 * common >= 90 * (200 + len(other) - common))))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    marks = ngram_join._parities(np.concatenate(sets), bounds)
    signed = spark.createDataFrame(
        [(i, *(int(x) for x in row)) for i, row in enumerate(marks)],
        "id long, " + ", ".join(f"{c} long" for c in ngram_join.SIGNED),
    )
    met = spark.createDataFrame(pairs, "a long, b long, n long, m long, link boolean")
    kept = {r.a for r in ngram_join._possible(met, signed, HOW).collect()}
    assert {p[0] for p in pairs if p[4]} <= kept
    assert len(kept) < len(pairs)


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_small_components_are_few_files(spark, many_partitions):
    chains = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 10 <> 9")
    roots = links.components(chains)
    assert {(r.id, r.root) for r in roots.collect()} == {(i, i - i % 10) for i in range(2000)}
    cores = spark.sparkContext.defaultParallelism
    assert len(roots.inputFiles()) <= cores
    more = links.extended(roots, spark.createDataFrame([(9, 10), (5, 5000)], "a long, b long"))
    found = {r.id: r.root for r in more.collect()}
    assert found[19] == 0 and found[5000] == 0 and found[20] == 20 and len(found) == 2001
    assert len(more.inputFiles()) <= cores


def test_spans_are_stored_before_texts_are_dealt_out(spark):
    rng = random.Random(7)
    passage = _words(rng, 55)
    docs = spark.createDataFrame(
        [(k, " ".join(_words(rng, 20) + passage)) for k in range(3)], "doc_id long, text string"
    )
    spans = substrings.repeated_spans(docs)
    assert "Exchange" not in spans._jdf.queryExecution().toString()
    assert {(r.doc_id, tuple(sorted(r.starts))) for r in spans.collect()} == {
        (k, tuple(range(20, 26))) for k in (1, 2)
    }
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeated(docs).collect()}
    assert removed == {0: 0, 1: 55, 2: 55}


def test_what_intervals_share_stands_together(spark):
    rows = phrases._intervals(
        spark.createDataFrame([], "shard long, psi binary, lows array<int>, lengths array<int>, names array<long>")
    )
    assert rows.columns == ["n", "shard", "first", "last", "low"]


def _shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (held.apply(i).getName() for i in range(held.size())) if n.startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files made since that are still there two seconds later."""
    for _ in range(20):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    return _shuffle_files(spark) - before


def test_stored_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counted = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count()
    table = shared.store(counted.join(spark.range(100).withColumnRenamed("id", "k").repartition("k"), "k"), "counted")
    assert not _left(spark, before)
    assert spark.conf.get(shared.CLEANUP, None) is None
    assert table.count() == 100


def test_sketches_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    shape = sketch.Shape(bits=16, rows=1)
    table = sketch.count(spark.range(1000), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), shape)
    assert table.sum() == 1000
    assert not _left(spark, before)


def test_stored_tables_are_packed(spark):
    assert all(name.endswith(".zstd.parquet") for name in shared.store(spark.range(10), "ten").inputFiles())


def test_no_byte_of_a_text_is_dealt_out_twice(spark):
    rows = spark.createDataFrame(
        [(i, i, "s", bytearray(b"x" * n), 0) for i, n in enumerate((0, 3, 64, 65, 300))],
        "rid long, doc_id long, sha string, rest binary, grp long",
    )
    found = {r.rid: (len(r.digit), r.ended, r.rest and len(r.rest)) for r in exact._digits(rows, 64).collect()}
    assert found == {0: (0, True, None), 1: (3, True, None), 2: (64, True, None), 3: (64, False, 1), 4: (64, False, 236)}


def test_texts_are_deleted_when_dealt_out(spark):
    docs = spark.createDataFrame([(1, "a" * 100), (2, "A" * 100), (3, "b")], "doc_id long, text string")
    before = len(shared._written)
    out = exact.exact_groups(docs)
    there = [p for p in shared._written[before:] if os.path.exists(p)]
    assert there and not [p for p in there if "exact-rows" in p]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()} == {
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)
    }
    held = exact.exact_groups(docs, carry=("text",))
    assert {r.doc_id: r.text for r in held.collect()} == {1: "a" * 100, 2: "A" * 100, 3: "b"}


def test_first_shingles_are_deleted_when_in_lists(spark):
    before = len(shared._written)
    out = ngram_join.ngram_links(_chance_and_copies(spark), HOW)
    there = [os.path.basename(p) for p in shared._written[before:] if os.path.exists(p)]
    assert there and not [name for name in there if name.startswith("sets-")]
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i for i in range(11)} | {11: 10}
