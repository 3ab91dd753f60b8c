"""Bands of the quality rules where copies or small languages would move them."""

import random

import pytest

from bizmetrics.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, letters, n=120):
    words = ["".join(rng.choices(letters, range(len(letters), 0, -1), k=rng.randint(2, 8))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def judged(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return {r.doc_id: r.kept for r in quality.quality(docs).collect()}


@pytest.fixture(scope="module")
def clean():
    rng = random.Random(5)
    return [prose(rng, "etaoinshrdlu") for _ in range(60)], [prose(rng, "zyxwvbkgpqmf") for _ in range(40)]


def test_copies_of_one_text_lose_no_others(spark, clean):
    one, two = clean
    rows = [(t, "a") for t in one] + [(t, "b") for t in two] + [(two[0], "b")] * 400
    assert all(judged(spark, rows).values())


def test_two_texts_of_a_language_stay(spark, clean):
    one, two = clean
    rows = [(t, "a") for t in one] + [(two[0], "b"), (prose(random.Random(6), "etaoinshrdlu"), "b")]
    assert all(judged(spark, rows).values())


def test_symbols_still_go_beside_copies(spark, clean):
    one, _ = clean
    noise = random.Random(8)
    junk = " ".join("".join(noise.choices("#*$%&|<>", k=5)) for _ in range(100))
    kept = judged(spark, [(t, "a") for t in one] + [(one[0], "a")] * 200 + [(junk, "a")])
    assert not kept.pop(260) and all(kept.values())
