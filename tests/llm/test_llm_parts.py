"""The methods inside the operators, against plain versions on small or random input."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from bizmetrics.llm import bpe, exact, links, ngram_join, packing, quality, sketch, substrings, text, tokenfile, tokens
from tests.llm import brute

ALPHABET = [" ", " ", "  ", "\n", "\t", "a", "b", "the", "'s", "'", "é", "1", "23", "!", ".", ",", " ",
            " ", "\x1c", "\x85", "日", "本", "<|endoftext|>", "'ll", "\r\n", "😀", "ﬁ", "²", "Ⅷ", "​"]


def random_texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_of_chunks():
    texts = [*random_texts(300, 30), None, "", " ", "a", "x" * 5000]
    column = pa.array(texts)
    seen = {}
    for chunk in text.chunks(column, size=200):
        starts, ends, first = text.word_bounds(chunk)
        hashes = text.word_hashes(chunk, starts, ends, 1)
        for i in range(chunk.size):
            own = [chunk.data[s:e].tobytes().decode() for s, e in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
            assert own == brute.words(texts[chunk.first + i])
            for word, h in zip(own, hashes[first[i]:first[i + 1]]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    library.encode_special_tokens = True
    own.known = tokens.Known(6, 300)  # forgets all the time
    texts = random_texts(3000, 14)
    odd = ["", " ", "  a", "a ", " a b", "a  b c", "a\u3000b c", "é\x85 x y", "don't stop\n\nnow . ..", "\x1c a"]
    texts += odd + [" ".join(odd), None, "x" * 5000 + " y", "<|endoftext|> z"]
    for size in (1, 7, len(texts)):
        for i in range(0, len(texts), size):
            part = texts[i : i + size]
            want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
            assert [ids.tolist() for ids in own.encode_column(pa.array(part, pa.string()))] == want


def test_known_units():
    """Every key is found with what it was added with, as long as there is room."""
    rng = np.random.default_rng(5)
    first = rng.integers(1, 40, 3000, dtype=np.uint64) << np.uint64(20)  # all want few slots
    first |= rng.integers(0, 1 << 12, 3000, dtype=np.uint64)
    first = np.unique(first)
    second = rng.integers(0, 1 << 63, len(first), dtype=np.uint64)
    table = tokens.Known(13, 100)
    table.add(first, second, np.arange(len(first)), np.ones(len(first), np.int32))
    slot = table.find(first, second)
    assert (slot >= 0).mean() > 0.9
    assert (table.start[slot[slot >= 0]] == np.flatnonzero(slot >= 0)).all()
    assert (table.find(first, second + np.uint64(1)) == -1).all()


def test_bpe_tree_is_the_library():
    codec = bpe.Codec.get(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    some = [t for t in codec.ranks if 1 < len(t) < 12]
    texts = random_texts(1500, 20, 3) + ["a" * 5000, "ab" * 700, "é" * 900, " " * 333 + "x"]
    texts += [b"".join(rng.choice(some) for _ in range(rng.randint(1, 20))).decode(errors="ignore") for _ in range(1500)]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4")
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_joins_like_direct_merging():
    codec = bpe.Codec.get(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(4)
    for _ in range(2000):
        data = bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randint(2, 120)))
        cut = rng.randint(0, len(data))
        assert codec.join(codec._merge_short(data[:cut]), codec._merge_short(data[cut:])) == codec._merge_short(data)
        assert codec._merge_long(data) == codec._merge_short(data)


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 4000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (
        rng.integers(0, 50_000, n), rng.integers(7, 9, n), np.full(n, 3),
        np.where(rng.random(n) < 0.02, 4_000_000_000, rng.integers(0, 200, n)),
    ):
        data = tokenfile.encode(ids.astype("<u4"))
        assert (tokenfile.decode(data) == ids).all()
        if n > 1024:
            assert (tokenfile.decode_block(data, 1) == ids[1024:2048]).all()


def test_blocks_keep_outliers_apart():
    ids = np.arange(1024) % 100
    ids[::100] = 2**31
    assert len(tokenfile.encode(ids.astype("<u4"))) < 1024 * 7 / 8 + 11 * 6 + 40


def places(counts, capacity):
    rows, out = packing.plan(counts, capacity), []
    for length, n in counts.items():
        own = rows[rows[:, 0] == length]
        for rank in range(n):
            _, first, sequence, per, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            out.append((sequence + (rank - first) // per, offset + (rank - first) % per * length, length))
    return out


def least_bins(lengths, capacity):
    """Exact minimum, by search; few pieces only."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= lengths[i]}:
            left = list(rooms)
            left[left.index(r)] -= lengths[i]
            go(i + 1, left)
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_plan_fills_without_gaps():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 20, 100, 2048])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        fill = {}
        for sequence, offset, length in sorted(places(counts, capacity)):
            assert offset == fill.get(sequence, 0)
            fill[sequence] = offset + length
        assert all(v <= capacity for v in fill.values())


def test_reduction_is_optimal():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        counts = Counter(lengths)
        fixed = packing.reduce(counts, 12)
        rest = list(counts.elements())
        assert sum(n for _, n in fixed) + least_bins(rest, 12) == least_bins(lengths, 12)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.zipf(1.3, 50_000) % (1 << 24), return_counts=True)
    model = quality.KneserNey(keys.astype(np.int32), counts)
    for context in (0, 5, 77, 12345):
        own = (context * 64 + np.arange(64)).astype(np.int32)
        assert np.exp(model.log_prob(own)).sum() == pytest.approx(1, abs=1e-4)
    some = rng.integers(0, 1 << 24, 1000).astype(np.int32)
    assert (model.score(some) == model.log_prob(some)).all()


def test_sketch_never_underestimates(spark):
    shape = sketch.Shape(bits=16, rows=2)
    df = spark.range(20_000).selectExpr("id % 3000 as k").repartition(4)

    def keys(batch):
        yield batch.column(0).to_numpy().astype(np.uint64)

    table = sketch.count(df, keys, shape)
    got = sketch.estimate(table, shape, np.arange(3000).astype(np.uint64))
    want = np.bincount(np.arange(20_000) % 3000)
    assert (got >= want).all() and (got == want).mean() > 0.9
    twice = sketch.AtLeast(df, keys, shape, 2)
    assert twice(np.arange(3000).astype(np.uint64)).all()
    assert twice(np.arange(10_000, 20_000).astype(np.uint64)).mean() < 0.05


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.id: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if any(k in e and e[0] != e[1] for e in edges)}


def near_copies(seed, families, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                own += [rng.choice(vocabulary)] * rng.randint(1, 9)
            out.append(" ".join(own).title() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("how,hot", [((3, 90, 100), 5000), ((3, 90, 100), 3), ((5, 80, 100), 4), ((2, 60, 100), 5)])
def test_join_is_all_pairs(spark, how, hot):
    docs = near_copies(how[0] + hot, 25, 14, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = ngram_join.ngram_links(df, ngram_join.Similarity(*how), hot=hot).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == {d[0]: c for d, c in zip(docs, brute.components(docs, *how), strict=True)}


def test_join_compares_members_between_bounds(spark):
    """Two heads that don't link, but members of their blocks do."""
    base = [f"v{i}" for i in range(300)]

    def changed(*at):
        return " ".join("x" + w if i in at else w for i, w in enumerate(base))

    steps = [changed(), changed(30, 60), changed(30, 60, 90, 120), changed(30, 60, 90, 120, 150, 180),
             changed(30, 60, 90, 120, 150, 180, 210, 240), changed(*range(30, 300, 25)), changed(*range(30, 300, 12))]
    docs = list(enumerate(steps * 2, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for how in ((3, 90, 100), (3, 95, 100), (3, 85, 100)):
        rows = ngram_join.ngram_links(df, ngram_join.Similarity(*how)).collect()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        assert got == {d[0]: c for d, c in zip(docs, brute.components(docs, *how), strict=True)}


def test_exact_over_several_digits(spark):
    long = "Ab" * 3000
    texts = [long, long.lower(), long + "c", long[:-1] + "z", "a", "A", "", None, "x" * 64, "x" * 65, "X" * 64, "é", "É"]
    docs = list(enumerate(texts, 1))
    rows = exact.exact_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == brute.exact(docs)


def test_passages(spark):
    rng = random.Random(7)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(40, 120))] for k in range(6)]
    docs = []
    for doc_id in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += [rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 70))]
            own += rng.choice(passages)[rng.randint(0, 20):]
        docs.append((doc_id, "  ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.remove_repeated(df).collect()}
    for (doc_id, text_), (n, gone, left) in zip(docs, brute.without_repeats(docs, 50), strict=True):
        assert (got[doc_id].n_words, got[doc_id].n_removed) == (n, gone)
        assert got[doc_id].kept_text == (" ".join(left) if gone else text_)


def test_bounds_of_similarity():
    how = ngram_join.Similarity(3, 90, 100)
    for n in range(1, 200):
        assert how.prefix(np.array([n]))[0] == n - math.ceil(0.9 * n - 1e-9) + 1


def test_vocabulary_file_has_all_bytes():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        assert {base64.b64decode(line.split()[0]) for line in lines} >= {bytes([b]) for b in range(256)}
