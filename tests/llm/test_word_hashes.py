"""Words that a polynomial hash modulo 2**64 can't tell apart, and long words, are different words."""

import numpy as np
import pyarrow as pa
import pytest

from bizmetrics.llm import ngram_join, quality, substrings
from bizmetrics.llm.text import chunks, word_bounds, word_hashes

SWAP = str.maketrans("ab", "ba")


def _opposites(doublings: int) -> tuple[str, str]:
    """The alternating word of 2**doublings letters over a and b, and its opposite."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(SWAP)
    return word, word.translate(SWAP)


ONE, OTHER = _opposites(10)


@pytest.fixture(scope="module")
def alternating(spark):
    rest = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, ONE), (2, OTHER), (3, f"{ONE} {rest}"), (4, f"{OTHER} {' '.join(f'v{i}' for i in range(60))}"),
        (5, f"{ONE} {rest[:-4]}"), (6, f"{ONE}\n{OTHER}\nx\nx"),
        (7, " ".join([ONE] + ["same"] * 49)), (8, " ".join([OTHER] + ["same"] * 49)),
    ]
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")


def test_join_keeps_them_apart(alternating):
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_links(alternating, ngram_join.Similarity(3, 90, 100)).collect()}
    assert (got[1], got[2], got[7], got[8]) == (1, 2, 7, 8)
    assert got[3] == got[5] == 3


def test_nothing_is_removed(alternating):
    rows = alternating.filter("doc_id in (4, 7, 8)")
    assert [r.n_removed for r in substrings.remove_repeated(rows).collect()] == [0, 0, 0]


def test_lines_differ(alternating):
    got = {r.doc_id: r.n_dup_lines for r in quality.quality(alternating).collect()}
    assert got[6] == 1


@pytest.mark.parametrize("lengths", [range(1, 9), range(9, 65), range(65, 140)])
def test_equal_hashes_mean_equal_words(lengths):
    rng = np.random.default_rng(1)
    words = []
    for n in lengths:
        word = "".join(rng.choice(list("ab"), n))
        words += [word, word, word[:-1] + "c", "c" + word[1:], word[: n // 2] + "c" + word[n // 2 + 1 :]]
    (chunk,) = chunks(pa.array([" ".join(words), words[0]]))
    starts, ends, _ = word_bounds(chunk)
    hashes = word_hashes(chunk, starts, ends, 5)
    assert len(set(hashes.tolist())) == len(set(words))
    assert hashes[0] == hashes[-1]
    assert len(set(hashes.tolist()) & set(word_hashes(chunk, starts, ends, 6).tolist())) == 0
