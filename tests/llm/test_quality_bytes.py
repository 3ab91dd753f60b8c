"""The quality rules' model is over the bytes of the texts as they are, and dealt to parts."""

import math
import random

import numpy as np
import pytest

from bizmetrics.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, words, n=120):
    return " ".join(rng.choice(words) for _ in range(n))


def words(rng, letters, n=60):
    return ["".join(rng.choices(letters, range(len(letters), 0, -1), k=rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def clean():
    rng = random.Random(5)
    known = words(rng, "etaoinshrdlu")
    return [prose(rng, known) for _ in range(80)]


def judged(spark, texts):
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: r for r in quality.quality(docs).collect()}


def odd_case(text):
    rng = random.Random(9)
    return "".join(c.upper() if rng.random() < 0.5 else c for c in text)


def odd_letters(text):
    """Each letter with a mark that it has nowhere else, out of a block of the like."""
    return "".join(c if c == " " else chr(0x400 + (ord(c) * 7 + i) % 0x100) for i, c in enumerate(text))


def test_texts_in_odd_case_go(spark, clean):
    rows = judged(spark, [*clean, odd_case(clean[3])])
    assert not rows.pop(80).kept and all(r.kept for r in rows.values())


def test_odd_letters_of_another_script_go(spark):
    rng = random.Random(6)
    known = words(rng, "абвгдежзиклм")
    texts = [prose(rng, known) for _ in range(80)]
    rows = judged(spark, [*texts, odd_letters(prose(rng, words(rng, "abcdefghijkl")))])
    assert not rows.pop(80).kept and all(r.kept for r in rows.values())


def test_each_byte_is_its_own_symbol(spark, clean):
    """Texts that differ in digits, marks or the script alone."""
    rng = random.Random(7)
    digits = " ".join("".join(rng.choices("0123456789", k=4)) for _ in range(80))
    pairs = [(clean[0], clean[0].upper()), (digits, "".join("1" if c != " " else c for c in digits))]
    rows = judged(spark, [t for p in pairs for t in p] + clean)
    for i in range(len(pairs)):
        assert abs(math.log(rows[2 * i].perplexity / rows[2 * i + 1].perplexity)) > 0.05


@pytest.mark.parametrize("part, small", [(1 << 30, 1 << 30), (1 << 30, 4000), (3000, 1000)])
def test_perplexity_is_brute_force_over_bytes(spark, clean, monkeypatch, part, small):
    """In one part, in as many as there are partitions, and in more."""
    monkeypatch.setattr(quality, "PART", part)
    monkeypatch.setattr(quality, "SMALL", small)
    texts = [*clean, clean[0], clean[0], odd_case(clean[1]), "naïve Ωμέγα 12.5 %", "", "\x00 a", "x"]
    rows = judged(spark, texts)
    model = brute.KneserNey(texts, np.arange(256) ^ 32)
    for i, text in enumerate(texts):
        want = model.log_perplexity(text) if text else None
        got = rows[i].perplexity and math.log(rows[i].perplexity)
        assert got == (want if want is None else pytest.approx(want, abs=1e-4))


def test_model_grows_with_the_corpus(spark, clean):
    """No n-gram shares the count of another, however many there are."""
    rng = random.Random(8)
    texts = ["".join(chr(rng.randint(33, 0x2FF)) for _ in range(20_000)) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    part, _ = quality.part_of(docs)
    counted = quality.count_grams(docs, part).groupBy("gram").count().count()
    padded = [b"   " + t.encode() for t in texts]
    different = {t[i : i + 4] for t in padded for i in range(len(t) - 3)}
    assert counted == len(different) > 300_000
