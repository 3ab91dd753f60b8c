"""Ranked lexical search against plain counting, ties, edge cells, exactness of the tiles."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bizmetrics.llm import search

DOCS = "doc_id long, text string, n int, item string, score string, rank string"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=20):
    """Rows (item, rank, id, score) by the definition, one pair at a time."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in own if c)
    n_terms = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, counts in own:
            n, score = sum(counts.values()), 0
            for term in terms(text):
                if tf := counts.get(term, 0):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top], 1)]
    return out


def run(spark, docs, items, parts=3, **how):
    left = spark.createDataFrame([(i, t, 0, "x", "y", "z") for i, t in docs], DOCS).repartition(parts)
    right = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, doc_id string")
    got = search.ranked(left, right, **how)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "UPPER", "upper", "a1"]
    pick = lambda k: " ".join(rng.choices(words, range(len(words), 0, -1), k=k))
    return [(i, pick(rng.randint(0, 40))) for i in range(n)], [(i, pick(rng.randint(1, 12))) for i in range(15)]


@pytest.mark.parametrize("parts", [1, 7])
def test_is_brute_force(spark, parts):
    docs, items = corpus(1, 600)
    docs += [(1000 + i, docs[5][1]) for i in range(50)]  # ties
    assert run(spark, docs, items, parts) == brute(docs, items)


def test_passes_over_a_small_vocabulary(spark):
    docs, items = corpus(2, 80)
    assert run(spark, docs, items, vocabulary=8, top=3) == brute(docs, items, 3)


def test_defined_cases(spark):
    docs = [
        (5, None), (6, ""), (7, "!!! ,"), (None, "Alpha beta"), (9, "alpha BETA"), (9, "alpha BETA"), (9, "alpha"),
        (10, "alpha " * 30_000), (11, "gamma-delta_alpha"), (12, "epsilon"), (13, "zeta"), (14, "eta"), (15, "theta"),
    ]
    items = [(1, "ALPHA beta beta"), (2, None), (3, "absent"), (4, "delta.gamma"), (4, "epsilon"), (None, "zeta")]
    got = run(spark, docs, items)
    assert got == sorted(brute(docs, items), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    assert [r[2] for r in got if r[0] == 1][:3] == [9, 9, None]
    assert {r[0] for r in got} == {1, 4, None}


def test_empty_tables(spark):
    docs, items = corpus(3, 10)
    assert run(spark, docs, []) == []
    assert run(spark, [], items) == []


def test_tiles_stay_below_the_bound():
    texts = ["a " * 5 + "b c", "d e", " ".join(f"t{i}" for i in range(3000))]
    items = search.read_items(pa.array(texts))
    weight = np.full(len(items.terms), (1 << 53) // search.IMPACT // 6)
    cut = search.tiles(items, weight)
    covered = defaultdict(Counter)
    for tile in cut:
        largest = (tile.repeats * weight[tile.terms][:, None] * search.IMPACT).sum(axis=0)
        assert (largest < 1 << 53).all()
        for column, item in enumerate(tile.items.tolist()):
            covered[item].update({int(t): int(n) for t, n in zip(tile.terms, tile.repeats[:, column]) if n})
    assert all(covered[i] == Counter(own.tolist()) for i, own in enumerate(items.of_item))
    with pytest.raises(ValueError):
        search.tiles(items, weight * 10)
