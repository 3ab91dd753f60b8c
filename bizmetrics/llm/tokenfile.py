"""Token ids as files: pages of whole documents, ids in patched frame-of-reference blocks.

A page holds some documents in ascending id order; its ids are cut into blocks of ``BLOCK``.
A block stores its least id, and the differences from it packed at the width that fits
``PERCENT`` percent of them; the rest keep their low bits there and stand in full in the
block's exception list. A directory of block starts lets a reader go to any block.

Payload, little-endian: u32 ids, u32 blocks, u32 start of each block in bytes from the
payload's begin; a block is u32 least, u8 width, u16 exceptions, packed bits (lowest first),
u16 positions and u32 differences of the exceptions. The lengths and the order of a page's
documents are columns beside it. Pages are written by Spark, one shard a task, as rows of
Parquet files, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare, store
from bizmetrics.llm.tokens import Encoder

BLOCK = 1024
PERCENT = 90
PAGE = 1 << 16  # ids of a page; a longer document is a page of its own
_HEAD = struct.Struct("<IBH")


def _bits(values: np.ndarray) -> np.ndarray:
    """Binary digits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode(ids: np.ndarray, block: int = BLOCK, percent: int = PERCENT) -> bytes:
    ids = ids.astype(np.int64)
    out, starts = [], []
    n_blocks = -(-len(ids) // block)
    at = 8 + 4 * n_blocks
    for b in range(n_blocks):
        own = ids[b * block : (b + 1) * block]
        least = int(own.min())
        diff = own - least
        ranked = np.partition(diff, (len(diff) - 1) * percent // 100)
        width = int(_bits(ranked[[(len(diff) - 1) * percent // 100]])[0])
        odd = np.flatnonzero(diff >> width)
        packed = np.packbits(
            (diff[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel(), bitorder="little"
        ).tobytes()
        data = b"".join((
            _HEAD.pack(least, width, len(odd)), packed,
            odd.astype("<u2").tobytes(), diff[odd].astype("<u4").tobytes(),
        ))
        starts.append(at)
        at += len(data)
        out.append(data)
    return struct.pack("<II", len(ids), n_blocks) + np.array(starts, "<u4").tobytes() + b"".join(out)


def decode_block(data: bytes, b: int, block: int = BLOCK) -> np.ndarray:
    """Ids of one block of a payload, found through the directory."""
    n, _ = struct.unpack_from("<II", data)
    (at,) = struct.unpack_from("<I", data, 8 + 4 * b)
    size = min(block, n - b * block)
    least, width, n_odd = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    n_packed = (size * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n_packed, at), count=size * width, bitorder="little")
    diff = bits.reshape(size, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    at += n_packed
    odd = np.frombuffer(data, "<u2", n_odd, at)
    diff[odd] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return diff + least


def decode(data: bytes, block: int = BLOCK) -> np.ndarray:
    _, n_blocks = struct.unpack_from("<II", data)
    parts = [decode_block(data, b, block) for b in range(n_blocks)]
    return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def write(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end: int | None = 2,
) -> None:
    """Encode all texts, append ``end`` to each, and write shards in ascending id order.

    Defined cases: a null text is empty; a null id comes first; rows that repeat an id follow
    one another, ordered by a hash of the text; an empty table gives no page; other columns
    are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["shard", "page", "first", "doc_ids", "lengths", "ids"]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.get(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[object, bytes]] = []
        state = {"page": 0, "first": 0}

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            lengths = [len(ids) // 4 for _, ids in held]
            payload = encode(np.frombuffer(b"".join(ids for _, ids in held), "<u4"))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([state["page"]], pa.int32()),
                    pa.array([state["first"]], pa.int64()),
                    pa.array([[i for i, _ in held]], pa.list_(id_type)),
                    pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                names=names,
            )
            state["page"] += 1
            state["first"] += sum(lengths)
            held.clear()
            return batch

        size, id_type = 0, None
        for batch in batches:
            id_type = batch.column(1).type
            for ids, doc_id in zip(encoder.encode_column(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                ids = ids.tobytes() + tail
                if held and size + len(ids) > 4 * PAGE:
                    yield flush(id_type)
                    size = 0
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flush(id_type)

    ordered.mapInArrow(
        pages, f"shard int, page int, first long, doc_ids array<{kind}>, lengths array<long>, ids binary"
    ).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (u32, little-endian).

    ``start`` counts the ids of all documents before it, in the order of the files.
    """
    prepare(spark)
    pages = spark.read.parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row a shard, that is a task of the writer.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = pages.groupBy("shard").agg(F.sum(size).alias("n"))
    # Stored: Spark sees its size and does not shuffle the pages to join a small table.
    shards = store(shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards")
    rows = pages.join(shards, "shard").select(
        "doc_ids", "lengths", (F.col("base") + F.col("first")).alias("first"), "ids"
    )
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, first, data in zip(*batch.columns, strict=True):
                n = lengths.values.to_numpy()
                stop = np.cumsum(n)
                ids = decode(data.as_py()).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.values, pa.array(stop - n + first.as_py()), pa.array(n),
                        pa.array([ids[4 * (e - k) : 4 * e] for e, k in zip(stop.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return rows.mapInArrow(unpack, f"doc_id {kind}, start long, n_tokens long, ids binary")


def checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``."""
    return rows.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


