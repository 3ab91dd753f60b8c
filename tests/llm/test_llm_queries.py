"""Registered queries of the training-data operators: against SQL, libraries, brute force."""

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from bizmetrics.llm import quality, queries, sql
from testkit import compare
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.queries(), sql.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_thirteen_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert compare.difference(got, duck.execute(ORACLE[name]).fetchdf()) is None


def test_bpe_is_the_library(spark, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op2_byte_bpe"](spark, SF_DIR).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_are_the_library(spark, documents, tokenizer):
    rows = sorted(QUERIES["op6_token_files"](spark, SF_DIR).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(documents)
    start = 0
    for r in rows:
        ids = [*tokenizer(documents[r.doc_id].text), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packing(rows, texts, tokenizer, capacity=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    total = 0
    for doc_id, own in pieces.items():
        ids = [*tokenizer(texts[doc_id]), 0]
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(own):
            assert (r.piece, r.start) == (n, at)
            assert n == 0 or r.length == capacity
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    least = math.ceil(total / capacity)
    assert len(sequences) <= max(least + 2, 1.02 * least)


def test_packing(spark, documents, tokenizer):
    rows = QUERIES["op7_best_fit_packing"](spark, SF_DIR).collect()
    check_packing(rows, {i: d.text for i, d in documents.items()}, tokenizer)


def test_language_on_held_out_rows(spark, documents):
    rows = QUERIES["op8_language_id"](spark, SF_DIR).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([documents[r.doc_id].lang == r.lang_pred for r in held]) > 0.95


def brute_quality(documents):
    model = brute.KneserNey([d.text or "" for d in documents.values()], quality.FOLD)
    score = {i: model.log_perplexity(d.text) for i, d in documents.items() if d.text}
    passed = [i for i, d in documents.items() if not brute.failed(d.text)]
    band = brute.bands(
        [(documents[i].lang, score[i]) for i in passed], quality.WIDTH, quality.LEAST, quality.STEP
    )
    kept = {i for i in passed if band[documents[i].lang][0] <= score[i] <= band[documents[i].lang][1]}
    return score, kept


def test_quality_is_brute_force(spark, documents):
    score, kept = brute_quality(documents)
    rows = QUERIES["op5_quality_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(documents)
    for r in rows:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own == brute.counts(documents[r.doc_id].text)
        assert r.base_failed == brute.failed(documents[r.doc_id].text)
        assert r.kept == (r.doc_id in kept)
        if r.perplexity is not None:
            assert math.log(r.perplexity) == pytest.approx(score[r.doc_id], abs=1e-4)


def test_pipeline_is_brute_force(spark, documents, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared.store(stage(spark, docs, SF_DIR), "test")
        got.append((name, docs))
    _, kept = brute_quality(documents)
    texts = {i: documents[i].text for i in sorted(kept)}
    assert {r.doc_id: r.text for r in got[0][1].collect()} == texts
    same = brute.exact(list(texts.items()))
    texts = {i: t for i, t in texts.items() if same[i][2]}
    assert {r.doc_id: r.text for r in got[1][1].collect()} == texts
    near = brute.components(list(texts.items()), 5, 80, 100)
    texts = {i: t for (i, t), (_, root) in zip(texts.items(), near, strict=True) if i == root}
    assert {r.doc_id: r.text for r in got[2][1].collect()} == texts
    cut = brute.without_repeats(list(texts.items()), 50)
    texts = {
        i: " ".join(left) if gone else t
        for (i, t), (n, gone, left) in zip(texts.items(), cut, strict=True)
        if not gone or gone < n
    }
    assert {r.doc_id: r.text for r in got[3][1].collect()} == texts
    assert all(r.n_chars == len(r.text) for r in got[3][1].collect())
    assert all(g.columns == list(corpus_pipeline.COLUMNS) for _, g in got[:4])
    check_packing(got[4][1].collect(), texts, tokenizer)
    whole = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "length", "ids_crc32")
    last = got[4][1].select("doc_id", "piece", "length", "ids_crc32")
    assert whole.exceptAll(last).isEmpty() and last.exceptAll(whole).isEmpty()
