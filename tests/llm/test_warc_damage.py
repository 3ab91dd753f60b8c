"""Damage of archives that is in no record, or in the packed bytes."""

import gzip
import zlib

import pytest

from bizmetrics.llm import shared, warc


@pytest.fixture(scope="module")
def primary(spark):
    path = shared.scratch(spark, "test-damage")
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "sha2(cast(id as string), 512) as html")
    warc.write(pages.coalesce(1), path)
    found = warc.files(spark, path)
    return shared.store(warc.records(found).drop("record"), "test-records"), found.collect()


def bad(spark, primary, files):
    replica = spark.createDataFrame([(f, bytearray(c)) for f, c in files], "file string, content binary")
    return [r for r in warc.audit(primary[0], replica).collect() if not r.replica_ok]


def test_changed_line_ends_are_found(spark, primary):
    [(file, packed)] = primary[1]
    third = primary[0].filter("nth = 3").head()
    content = bytearray(gzip.decompress(packed))
    content[third.offset + third.length + 1] = ord(" ")
    [row] = bad(spark, primary, [(file, gzip.compress(content))])
    assert row.id == third.id and row.replica_sha256 == third.sha256


@pytest.mark.parametrize("more", [b"more", gzip.compress(b"more")], ids=["raw", "packed"])
def test_bytes_behind_the_end_are_found(spark, primary, more):
    [(file, packed)] = primary[1]
    [row] = bad(spark, primary, [(file, packed + more)])
    assert (row.id, row.offset, row.length) == (None, len(gzip.decompress(packed)), 0)


def test_files_of_the_replica_alone_are_found(spark, primary):
    [(file, packed)] = primary[1]
    [row] = bad(spark, primary, [(file, packed), ("other", gzip.compress(b"x")), ("empty", b"")])
    assert (row.id, row.file, row.sha256) == (None, "other", None)
    assert bad(spark, primary, [(file, gzip.compress(gzip.decompress(packed), 1))]) == []


def test_a_flipped_bit_leaves_the_records_before_it(spark, primary):
    [(file, packed)] = primary[1]
    at, data = len(packed) // 2, bytearray(packed)
    data[at] ^= 4
    rows = bad(spark, primary, [(file, bytes(data))])
    before = zlib.decompressobj(31).decompress(packed[: at - 8])
    ids = {r.id for r in rows}
    whole = [r.id for r in primary[0].collect() if r.offset + r.length + 4 <= len(before)]
    assert len(whole) > 10 and ids.isdisjoint(whole) and len(rows) > 1


def test_a_wrong_checksum_leaves_all_records(spark, primary):
    [(file, packed)] = primary[1]
    [row] = bad(spark, primary, [(file, packed[:-6] + bytes([packed[-6] ^ 1]) + packed[-5:])])
    assert row.id is None
