"""Token-id files: blocks of ids, transposed into planes, each compressed with zstandard.

A file set is a Parquet folder used as a container that any Hadoop store can hold. One row is a
segment: whole documents of one shard in ascending doc_id order, cut into blocks of a fixed number
of ids. A block is transposed into byte planes (or bit planes) and each plane is compressed alone;
planes above the block's largest id are left out. The other columns are the chunk index:

    shard, segment   place of the segment; shards ascend with doc_id
    shard_start      ids of the shard before this segment
    doc_ids, doc_lens, n_ids   the documents and their numbers of ids, the end id included
    planes           "byte" or "bit"; block_ids: ids of each block but the last
    index            for each block: its number of planes, then the compressed size of each
    payload          the compressed planes, one after the other

So a reader can find a range of ids from the index and decode only the blocks that hold it.

Defined results: null and empty texts give the end id alone; repeated doc_ids stand side by side,
ordered by text; a null doc_id sorts first; an empty table gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.common import flat_binary, joined, release_memory
from tessel.llm.tokens import encoded, encoder

SEGMENT = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, planes string, block_ids int, index array<long>, payload binary"
DECODED = "doc_id long, shard int, shard_start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Planes of a block, lowest first, up to the highest that has a set bit."""
    top = int(ids.max(initial=0)).bit_length()
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [rows[:, k].tobytes() for k in range((top + 7) // 8)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(top)]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    rows = np.zeros((n, 4), dtype=np.uint8)
    if planes == "byte":
        for k, part in enumerate(parts):
            rows[:, k] = np.frombuffer(part, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, part in enumerate(parts):
            bits[:, k] = np.unpackbits(np.frombuffer(part, dtype=np.uint8))[:n]
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def encode_segment(ids: np.ndarray, planes: str, block_ids: int, level: int = 3) -> tuple[list[int], bytes]:
    pack, index, payload = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block_ids):
        parts = [pack.compress(x) for x in to_planes(ids[at : at + block_ids], planes)]
        index += [len(parts), *map(len, parts)]
        payload += parts
    return index, b"".join(payload)


def decode_segment(payload: bytes, index: list[int], n_ids: int, planes: str, block_ids: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids [low, high) of a segment; blocks outside that range are skipped by the index."""
    high, unpack = n_ids if high is None else min(high, n_ids), zstandard.ZstdDecompressor()
    out, at, k = [], 0, 0
    for first in range(0, n_ids, block_ids):
        n, sizes = min(block_ids, n_ids - first), index[k + 1 : k + 1 + index[k]]
        if first < high and first + n > low:
            ends = at + np.cumsum(sizes, dtype=np.int64)
            block = from_planes([unpack.decompress(payload[e - s : e]) for s, e in zip(sizes, ends, strict=True)], n, planes)
            out.append(block[max(0, low - first) : high - first])
        at, k = at + sum(sizes), k + 1 + index[k]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, planes: str = "byte", block_ids: int = 16_384, segment_ids: int = 1 << 19, kept_pieces: int = 800_000) -> None:
    """Encodes doc_id and text of `docs` with the tokenizer file and writes the file set to `path`.

    Texts are dealt by ranges of doc_id, so each shard is encoded and written by one task and a
    segment never leaves its task's memory. A document of any length stays in one segment. A worker
    keeps at most twice `kept_pieces` pieces of text with their ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(tokenizer, kept_pieces), TaskContext.get().partitionId()
        names, lens, parts, size, segment, before = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            index, payload = encode_segment(np.concatenate(parts), planes, block_ids)
            one = [[shard], [segment], [before], [size], [names], [lens], [planes], [block_ids], [index], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(x, type=t) for x, t in zip(one, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            for doc_id, ids in encoded(coder, batch, end_id):
                names.append(doc_id)
                lens.append(len(ids))
                parts.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
                    names, lens, parts, size, segment, before = [], [], [], 0, segment + 1, before + size
        release_memory()
        if names:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, SEGMENT)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of each document."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["payload"], row["index"], row["n_ids"], row["planes"], row["block_ids"])
                lens = np.array(row["doc_lens"], dtype=np.int64)
                starts = row["shard_start"] + np.cumsum(lens) - lens
                columns = [pa.array(row["doc_ids"], type=pa.int64()), pa.array(np.full(len(lens), row["shard"], dtype=np.int32)), pa.array(starts), pa.array(lens), flat_binary(ids.astype("<u4").tobytes(), lens * 4)]
                yield pa.record_batch(columns, names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    rows = spark.read.parquet(path)
    # one row for each shard: as many as there were write tasks
    bases = rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    return joined(rows.mapInArrow(decode, DECODED), bases, ["shard"], "inner").select("doc_id", (F.col("shard_start") + F.col("base")).alias("start"), "n_tokens", "ids")
