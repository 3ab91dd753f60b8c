"""Phrase collocations against plain counting, indexes, shards of any size, edge cells."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bizmetrics.llm import phrases

SCHEMA = "doc_id long, text string, lang string, shard string, f string, id string, first string"


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least=30, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, words[i : i + n]
                longest[key] = max(longest[key], a)
    out = []
    for (lang, words), a in candidates.items():
        if longest[lang, words] and 100 * longest[lang, words] >= 80 * a:
            continue
        cuts = [(f[lang, words[:k]], f[lang, words[k:]], k) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked, nth = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        nth[lang] += 1
        if nth[lang] <= top:
            ranked.append((lang, nth[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return ranked


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(1, t, lang, "s", "f", "i", "x") for t, lang in rows], SCHEMA).repartition(parts)
    got = phrases.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(map(tuple, got.collect()))


def corpus(seed, n, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "Été", "日本", "a-b", "x"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, range(len(words), 0, -1))[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((text + "in new york city hall" * rng.randint(0, 1), rng.choice(langs)))
    return rows


@pytest.mark.parametrize(("parts", "size"), [(1, phrases.SHARD), (5, 400)])
def test_is_brute_force(spark, parts, size):
    rows = corpus(1, 300)
    got = run(spark, rows, parts, least=5, size=size)
    assert got == brute(rows, 5)
    assert len(got) > 100


def test_top_and_ties(spark):
    rows = [("b a. c a. d a", "en")] * 40 + [("é z. ~ z", "en")] * 40
    got = run(spark, rows, top=3)
    assert [r[2] for r in got] == ["~ z", "é z", "b a"]
    assert got == brute(rows, top=3)


def test_defined_cases(spark):
    long = "go on " * 40_000
    rows = [
        (None, "en"), ("", "en"), (" \t\n..", "xx"), ("One two", None), ("one TWO", "und"), (long, "en"), (long, "en"),
        ("x" * 20_000, "en"), ("one. two", "und"), ("a\x00b c\x1fd", "und"), ("a\x00b c\x1fd", "und"),
    ]
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [("only once here", "en")]) == []


def test_index_extends_to_all_ngrams():
    rng = np.random.default_rng(3)
    numbers = np.concatenate([[0], rng.integers(0, 6, 400), [0]]).astype(np.int32)
    names = np.array([10, 11, -1, 13, 14])  # word 3 is in no n-gram
    psi, named = phrases.index(numbers, names)
    of = np.concatenate([[-1], names])[numbers]
    known = {(n,): n for n in (10, 11, 13, 14)}
    for n in range(2, phrases.DEPTH + 1):
        want = Counter(tuple(of[i : i + n].tolist()) for i in range(len(of) - n + 1) if (of[i : i + n] >= 0).all())
        low, size, first, last = phrases.extend(psi, named)
        back = {v: k for k, v in known.items()}
        got = {(*back[a], back[b][-1]): int(c) for a, b, c in zip(first.tolist(), last.tolist(), size.tolist(), strict=True)}
        assert got == want
        known = {k: 1000 * n + i for i, k in enumerate(got)}
        named = phrases._rows_named(len(psi), low, size, np.arange(len(low)) + 1000 * n)


def test_word_numbers():
    words, counts, numbers = phrases.word_numbers(pa.array(["B a,b", "a", "", "a\tÉ"]))
    assert dict(zip(words.to_pylist(), counts.tolist(), strict=True)) == {"b": 2, "a": 3, "É": 1}
    read = [words[n - 1].as_py() if n else "" for n in numbers.tolist()]
    assert read == ["", "b", "a", "", "b", "", "a", "", "a", "É", ""]
