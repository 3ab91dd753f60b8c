"""WARC archives and their fixity: Merkle trees over records, compared from the roots down.

``write`` makes WARC files with Spark's text writer: a record is its header and payload, the
two line ends after it are the line separator. The files are gzip streams of many records;
offsets are those of the unpacked stream. A replica's tree hashes the byte ranges that the
primary's manifest names, and these tile the file: leaves are records with the line ends after
them, and last what is behind the primary's end, also packed bytes that can't be unpacked. A
node covers the ranges of ``FANOUT`` children in order, a root also the length of its file. An
audit joins the roots of two replicas and, level by level, only the children of nodes that
differ.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare, store

FANOUT = 16
FILE_RECORDS = 4096  # records of a file
STEP = 1 << 14  # packed bytes of a damaged file that are unpacked at once
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def record(record_id: Column, url: Column, payload: Column, date: str = DATE) -> Column:
    """A resource record without its final line ends; no target line for a null url."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", ""), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """Write every row as a record, without a shuffle; see ``audit`` for the defined cases."""
    rows = pages.select(record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("value"))
    (rows.write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of an archive; a file's name is the same in all replicas."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    name = F.regexp_extract("path", r"file=([^/]+)/[^/]+$", 1)
    return found.select(
        F.when(name != "", name).otherwise(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file"), "content"
    )


def _unpack(data: bytes) -> tuple[bytes, bytes]:
    """What the members of a gzip file hold, and its packed bytes from the first member on
    that is damaged, cut off or none. Of a damaged member what it gives before the error."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            out.append(_before_error(data))
            break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(out), data


def _before_error(data: bytes) -> bytes:
    """What a damaged member gives: to the error in steps of ``STEP`` packed bytes, the last
    step again byte by byte."""
    out, member = [], zlib.decompressobj(31)
    for at in range(0, len(data), STEP):
        before = member.copy()
        try:
            out.append(member.decompress(data[at : at + STEP]))
        except zlib.error:
            try:
                for k in range(at, at + STEP):
                    out.append(before.decompress(data[k : k + 1]))
            except zlib.error:
                break
    return b"".join(out)


def _ranges(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Record id, offset and length of each record, by the Content-Length lines."""
    at, end = 0, END.encode()
    while at < len(content):
        head = content.index(end, at)
        fields = dict(
            line.split(b": ", 1) for line in content[at:head].split(b"\r\n")[1:] if b": " in line
        )
        stop = head + 4 + int(fields[b"Content-Length"])
        yield fields[b"WARC-Record-ID"][len(b"<urn:page:") : -1], at, stop - at
        at = stop + 4


def _leaf(offset: int, data: bytes) -> str:
    return hashlib.sha256(b"%d:%d:" % (offset, len(data)) + data).hexdigest()


def records(found: DataFrame) -> DataFrame:
    """Every record of the primary: ``file, nth, id, offset, length, file_length, sha256,
    hash, record``. The hash is also of the line ends after the record. A primary that can't be
    unpacked to its end fails."""
    prepare(found.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, packed in zip(*batch.columns, strict=True):
                content, rest = _unpack(packed.as_py())
                if rest:
                    raise ValueError(f"{file}: {len(rest)} bytes that can't be unpacked")
                out = []
                for nth, (record_id, at, n) in enumerate(_ranges(content)):
                    own = content[at : at + n]
                    out.append((
                        file.as_py(), nth, record_id.decode(), at, n, len(content),
                        hashlib.sha256(own).hexdigest(), _leaf(at, content[at : at + n + len(END)]), own.decode(),
                    ))
                    if len(out) == 512:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*out, strict=True)],
            names=["file", "nth", "id", "offset", "length", "file_length", "sha256", "hash", "record"],
        )

    return found.select("file", "content").mapInArrow(
        parse,
        "file string, nth long, id string, offset long, length long, file_length long, "
        "sha256 string, hash string, record string",
    )


def leaves(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hashes of a replica's bytes in the ranges of the manifest (``file, nth, offset,
    length``; of length 0 is what is behind the last record): ``file, nth, offset, length,
    file_length, sha256, hash``. A file that the manifest lacks is one leaf."""
    prepare(found.sparkSession)
    # As many ranges as a file has records, FILE_RECORDS at most.
    ranges = manifest.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("nth", "offset", "length"))).alias("ranges")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, packed, own in zip(*batch.columns, strict=True):
                content, rest = _unpack(packed.as_py() or b"")
                ranges = own.as_py()
                if ranges is None:
                    ranges = [{"nth": 0, "offset": 0, "length": 0}] if content or rest else []
                out = []
                for r in ranges:
                    at, stop = r["offset"], r["offset"] + r["length"]
                    data = content[at:stop] if r["length"] else content[at:] + rest
                    leaf = content[at : stop + len(END)] if r["length"] else data
                    out.append((file.as_py(), r["nth"], at, r["length"], len(content),
                                hashlib.sha256(data).hexdigest(), _leaf(at, leaf)))
                if not out:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out, strict=True)],
                    names=["file", "nth", "offset", "length", "file_length", "sha256", "hash"],
                )

    joined = ranges.join(found, "file", "full").select("file", "content", "ranges")
    return joined.mapInArrow(
        run, "file string, nth long, offset long, length long, file_length long, sha256 string, hash string"
    )


def tree(level: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots: ``file, nth, begin, stop, hash``; stored.

    A node's hash is over its children's hashes and ranges in order; a root, the only node
    of its file, also covers the file's length.
    """
    nodes = store(
        level.select("file", "nth", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("stop"), "hash", "file_length"),
        "tree",
    )
    out = [nodes.drop("file_length")]
    while True:
        child = F.struct("nth", F.concat_ws(":", "begin", "stop", "hash").alias("text"))
        joined = nodes.groupBy("file", F.expr(f"nth div {fanout}").alias("nth")).agg(
            F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.max("file_length").alias("file_length"),
            F.concat_ws(";", F.transform(F.sort_array(F.collect_list(child)), lambda c: c["text"])).alias("text"),
        )
        nodes = store(
            joined.select("file", "nth", "begin", "stop", F.sha2("text", 256).alias("hash"), "file_length"), "tree"
        )
        if nodes.filter("nth > 0").isEmpty():
            root = F.sha2(F.concat_ws(":", "hash", "file_length"), 256)
            out.append(nodes.withColumn("hash", root).drop("file_length"))
            return out
        out.append(nodes.drop("file_length"))


def compare(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves in which two trees differ, found through differing nodes only: ``file, nth,
    begin, stop``. Both trees are over the same manifest."""
    suspects = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if suspects is not None:
            parents = suspects.select("file", F.col("nth").alias("parent"))
            a, b = (
                x.withColumn("parent", F.expr(f"nth div {fanout}"))
                .join(parents, ["file", "parent"], "left_semi").drop("parent")
                for x in (a, b)
            )
        other = b.select("file", "nth", F.col("hash").alias("other"))
        suspects = store(
            a.join(other, ["file", "nth"], "left").filter("not hash <=> other")
            .select("file", "nth", "begin", "stop"),
            "suspects",
        )
    return suspects


def audit(primary: DataFrame, replica_files: DataFrame) -> DataFrame:
    """Compare a replica with the primary's ``records``, stored and without ``record``.

    Returns one row per record of the primary: ``id, file, offset, length, sha256,
    replica_ok, replica_sha256`` (null where nothing differs, equal to ``sha256`` where only
    the line ends after the record do), and one for each difference that is in no record, with
    a null id and length 0: bytes behind the primary's end (also packed ones that can't be
    unpacked), from ``offset``, and a file that the primary lacks, with a null ``sha256``.
    Defined cases: a file that the replica lacks, or whose end is missing, differs in all
    records that are not whole there; packing that gives the same bytes is no difference, nor is
    a file without bytes that the primary lacks; a null payload is an empty one, null urls have
    no target line, null ids are empty; repeated rows are records of their own; an empty table
    gives an empty result; other columns are never archived.
    """
    ends = store(
        primary.groupBy("file").agg((F.max("nth") + 1).alias("nth"), F.max("file_length").alias("offset")).select(
            F.lit(None).cast("string").alias("id"), "file", "nth", "offset", F.lit(0).cast("long").alias("length"),
            F.col("offset").alias("file_length"), F.sha2(F.lit(""), 256).alias("sha256"),
            F.sha2(F.concat_ws(":", "offset", F.lit("0"), F.lit("")), 256).alias("hash"),
        ),
        "ends",
    )
    whole = primary.select(ends.columns).union(ends)
    copied = store(leaves(replica_files, whole.select("file", "nth", "offset", "length")), "replica-leaves")
    bad = compare(tree(whole), tree(copied)).select("file", "nth")
    damaged = copied.join(bad, ["file", "nth"], "left_semi").select(
        "file", "nth", F.col("sha256").alias("replica_sha256")
    )
    names = ["id", "file", "offset", "length", "sha256", "replica_sha256"]
    judged = whole.join(damaged, ["file", "nth"], "left").filter("length > 0 or replica_sha256 is not null")
    added = copied.join(ends.select("file"), "file", "left_anti").select(
        F.lit(None).cast("string").alias("id"), "file", "offset", "length",
        F.lit(None).cast("string").alias("none"), F.col("sha256").alias("replica_sha256"),
    )
    return judged.select(names).union(added).select(
        *names[:-1], F.col("replica_sha256").isNull().alias("replica_ok"), "replica_sha256"
    )


def copy(found: DataFrame, path: str, change: Column) -> None:
    """Write a replica of an archive, a folder a file, each record as ``change`` makes it
    from ``id`` and ``record``."""
    rows = records(found).select("file", "nth", change.alias("value"))
    # A file holds FILE_RECORDS records at most, so no task gets an unbounded group.
    (rows.repartition("file").sortWithinPartitions("file", "nth").select("file", "value")
     .write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path))
