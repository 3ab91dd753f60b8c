"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bizmetrics.llm import (
    bpe, exact, language, licenses, ngram_join, packing, quality, shared, substrings, tokenfile, warc,
)
from tests.llm import brute

TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Names that the operators use inside.
CLASHES = [
    "rid", "fp", "grp", "kept", "n", "id", "h1", "starts", "carried", "rest", "sha", "digit", "words",
    "found", "letters", "root", "shingle", "task", "nth", "shard", "page", "log_ppl", "low", "k",
]
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "Same Text here", "en"),
    (5, "same text HERE", "en"), (5, "same text HERE", "en"), (None, "same text here", None),
    (None, None, None), (6, LONG, "en"), (7, LONG, "de"), (8, "x" * 30_000, "en"),
    (9, f"first {PASSAGE} end", "fr"), (10, f"second {PASSAGE} tail", "fr"), (10, f"other {PASSAGE} tail", "fr"),
    (11, "Released under the MIT License. Under the MIT license; cc by-nc", "en"),
    (12, "é ß 日本 \U0001f600", "xx"), (13, "12345 !!", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


OPERATORS = {
    "join": lambda d: ngram_join.ngram_links(d, ngram_join.Similarity()),
    "bpe": lambda d: bpe.digests(d, TIKTOKEN),
    "round_trip": lambda d: bpe.round_trip(d, TIKTOKEN),
    "licenses": licenses.scan,
    "substrings": substrings.remove_repeated,
    "quality": quality.quality,
    "packing": lambda d: packing.pack_documents(d, TOKENIZER),
    "language": language.identify,
    "exact": exact.exact_groups,
    **{f"stage {n}": (lambda d, f=f: f(d.sparkSession, d, "")) for n, f in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(empty, name):
    got = OPERATORS[name](empty)
    assert got.collect() == [] and "doc_id" in got.columns


def files(df):
    path = shared.scratch(df.sparkSession, "test-files")
    tokenfile.write(df, path, TOKENIZER)
    return tokenfile.read(df.sparkSession, path)


def test_empty_files(empty):
    assert files(empty).collect() == []


def by_position(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_join(docs):
    rows = OPERATORS["join"](docs).collect()
    want = brute.components([r[:2] for r in ROWS], 3, 90, 100)
    assert by_position(rows, "doc_id", "n_shingles", "component_id") == sorted(
        ((r[0], *w) for r, w in zip(ROWS, want, strict=True)), key=repr
    )


def test_bpe(docs):
    rows = OPERATORS["round_trip"](docs).collect()
    assert by_position(rows, "doc_id", "decoded") == sorted(
        ((i, bytearray((t or "").encode())) for i, t, _ in ROWS), key=repr
    )
    assert {len(r.ids) for r in rows if not r.decoded} == {0}


def test_licenses(docs):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].labels, rows[1].score) == (0, 0, None, "", 0)
    own = rows[11]
    assert (own.n_words, own.n_base, own.first_word, own.last_word) == (12, 3, 1, 9)
    assert own.base_labels == own.labels == "cc-by-nc,mit" and own.score == 1


def test_license_notice(spark):
    text = licenses.TEMPLATES[5].text.replace("conditions", "terms").upper()
    broken = text.replace("BINARY", "OTHER")
    df = spark.createDataFrame([(1, f"x {text}."), (2, broken)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.n_base) for r in licenses.scan(df).collect()}
    assert got == {1: ("bsd", "", 0), 2: ("", "", 0)}


def test_substrings(docs):
    rows = OPERATORS["substrings"](docs).collect()
    want = brute.without_repeats([r[:2] for r in ROWS], 50)
    assert by_position(rows, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(
        ((r[0], n, gone, hashlib.sha256(" ".join(left).encode()).hexdigest())
         for r, (n, gone, left) in zip(ROWS, want, strict=True)), key=repr,
    )


def test_quality(docs):
    rows = quality.quality(docs).collect()
    assert by_position(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(
        ((i, *brute.counts(t)) for i, t, _ in ROWS), key=repr
    )
    assert all(r.perplexity is None for r in rows if r.n_words == 0 and r.doc_id in (1, 2))
    assert not any(r.kept for r in rows if r.base_failed)


def test_packing_and_files(docs):
    placed = OPERATORS["packing"](docs).collect()
    assert sum(r.piece == 0 for r in placed) == len(ROWS)
    fill = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    rows = sorted(files(docs).collect(), key=lambda r: r.start)
    assert len(rows) == len(ROWS)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at and r.ids[-4:] == (2).to_bytes(4, "little")
        at += r.n_tokens


def test_language(docs, spark):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} >= {1, 2, 3, None, 13}
    assert "xx" not in {r.lang_pred for r in rows.values()} or not rows[12].held_out
    none = language.Model([], None, None)
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_exact(docs):
    rows = exact.exact_groups(docs, carry=("lang",)).collect()
    assert len(rows) == len(ROWS)
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r)
    for own in groups.values():
        assert sum(r.kept for r in own) == 1
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert all((r.keep_id, r.group_size) == (max(ids, default=None), len(own)) for r in own)
    assert len(groups[hashlib.sha256(b"same text here").hexdigest()]) == 4
    assert len(groups[hashlib.sha256(b"").hexdigest()]) == 3


def test_stages_return_documents(docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = shared.store(stage(docs.sparkSession, docs, ""), "test")
        assert got.columns == list(corpus_pipeline.COLUMNS), name
        assert [f.dataType for f in got.schema] == [docs.schema[c].dataType for c in got.columns], name


PAGES = [
    (1, "http://a", "<p>one</p>"), (2, None, ""), (3, "http://c", None), (None, "x\r\ny", "WARC/1.0\r\n\r\n"),
    (4, "http://d", "é" * 40_000), (4, "http://d", "é" * 40_000), (5, "u", "\r\n\r\n"),
]


def archive(spark, pages, *changes):
    """Records of an archive, and a replica for each change."""
    one = shared.scratch(spark, "test-warc")
    warc.write(pages, one)
    found, replicas = shared.store(warc.records(warc.files(spark, one)), "test-records"), []
    for change in changes:
        two = shared.scratch(spark, "test-warc")
        warc.copy(warc.files(spark, one), two, change)
        replicas.append(warc.files(spark, two))
    return found, *replicas


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit("mine"))
    two = F.when(F.col("id") == "1", F.regexp_replace("record", "one", "two")).otherwise(F.col("record"))
    found, same, other = archive(spark, pages, F.col("record"), two)
    rows = found.collect()
    bodies = [r.record.split("\r\n\r\n", 1)[1] for r in rows]
    assert sorted(bodies) == sorted(p[2] or "" for p in PAGES)
    assert sum("WARC-Target-URI: xy\r\n" in r.record for r in rows) == 1
    assert all(r.replica_ok for r in warc.audit(found.drop("record"), same).collect())
    bad = [r for r in warc.audit(found.drop("record"), other).collect() if not r.replica_ok]
    assert [r.id for r in bad] == ["1"]
    assert bad[0].replica_sha256 != bad[0].sha256


def test_warc_losses(spark):
    pages = spark.range(600).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 5) as html").coalesce(1)
    found, short = archive(spark, pages, F.col("record"))
    none = found.limit(0).select("file", F.lit(b"").alias("content"))
    assert not any(r.replica_ok for r in warc.audit(found.drop("record"), none).collect())
    cut = F.expr("substring(content, 1, length(content) div 2)")
    rows = warc.audit(found.drop("record"), short.withColumn("content", cut)).orderBy("offset").collect()
    ok = [r.replica_ok for r in rows]
    assert not ok[-1] and ok == sorted(ok, reverse=True)


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found, same = archive(spark, pages, F.col("record"))
    assert found.collect() == [] and warc.audit(found.drop("record"), same).collect() == []


def test_near_copies_with_repeated_and_null_ids(spark):
    """One row of each group stays, whatever ids its rows and others have."""
    def text(name, change=None):
        words = [f"{name}{i}" for i in range(200)]
        return " ".join(words if change is None else [*words[:-1], change])

    rows = [
        (5, text("a")), (5, text("a", "x")), (5, text("b")), (None, text("c")), (None, text("c", "x")),
        (None, text("d")), (7, text("e")), (8, text("e", "x")), (7, text("f")), (None, text("e", "y")),
        (None, ""), (5, "  "),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) == 8
    stays = {t.split("0")[0] if t.strip() else t for _, t in got}
    assert stays == {"a", "b", "c", "d", "e", "f", "", "  "}
    assert (7, text("e")) in got
