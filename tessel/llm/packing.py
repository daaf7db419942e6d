"""Bounded-space online packing of token ids into fixed windows.

Every task keeps at most `open_windows` windows open. A document is cut into full windows and a
rest; the rest goes to the open window that it fills best. If none has room, the fullest is
emitted: padded if at most `waste` ids are free in it, else topped up with a cut of the rest. What
stays open at a task's end is merged by the same packer in rounds over groups of tasks, on lengths
alone, until one group is left; its last window is cut into lengths that are powers of two.

Defined results: null and empty texts are the end id alone; ties between windows go to the older;
an empty table gives an empty result; other columns are ignored; repeated doc_ids are packed as
separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, flat_binary, release_memory
from tessel.llm.tokens import encoded, encoder

PLACED = "part long, piece long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
MOVED = "part long, piece long, sub_start long, length long, slot long, sequence_id long, offset long"
#: Sequence ids are round, group and number: 6, 25 and 32 bits.
ROUND, GROUP = 57, 32


class Packer:
    """Best fit into a bounded number of open windows. A piece is (key, start, length)."""

    def __init__(self, size: int = 4096, open_windows: int = 32, waste: int = 32):
        self.size, self.most, self.waste = size, open_windows, waste
        self.free: list[int] = []
        self.open: list[list[tuple]] = []

    def add(self, key, start: int, length: int) -> Iterator[list[tuple]]:
        """Places a piece; yields the windows that close."""
        while length >= self.size:
            yield [(key, start, self.size)]
            start, length = start + self.size, length - self.size
        while length:
            fits = [x for x in self.free if x >= length]
            if fits:
                k = self.free.index(min(fits))
            elif len(self.open) < self.most:
                k = len(self.open)
                self.open.append([])
                self.free.append(self.size)
            else:
                k = self.free.index(min(self.free))
                if self.free[k] <= self.waste:
                    yield self.close(k)
                    continue
            put = min(length, self.free[k])
            self.open[k].append((key, start, put))
            self.free[k] -= put
            start, length = start + put, length - put
            if not self.free[k]:
                yield self.close(k)

    def close(self, k: int) -> list[tuple]:
        self.free.pop(k)
        return self.open.pop(k)

    def drain(self) -> Iterator[list[tuple]]:
        """The open windows filled up from one another; the last one in powers of two."""
        rest = [x for window in self.open for x in window]
        self.open, self.free = [], []
        window, room = [], self.size
        left = sum(n for _, _, n in rest)
        for key, start, length in rest:
            while length:
                if not window:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                put = min(length, room)
                window.append((key, start, put))
                start, length, room, left = start + put, length - put, room - put, left - put
                if not room:
                    yield window
                    window = []


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, open_windows: int = 32, waste: int = 32, group: int = 64, scratch: Scratch | None = None, kept_pieces: int = 800_000, keep: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit) of each piece.

    A worker keeps at most twice `kept_pieces` pieces of text with their ids, from task to task if `keep` is set;
    without it, it also takes less text at once.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer, kept_pieces), TaskContext.get().partitionId()
        packer, texts = Packer(size, open_windows, waste), {}
        done, sequence, piece = [], 0, 0

        def put(window: list[tuple], number: int) -> None:
            nonlocal piece
            offset = 0
            for key, start, length in window:
                doc_id, ids, _ = texts[key]
                done.append((part, piece, doc_id, start, length, len(ids), number, offset, ids[start : start + length].astype("<u4").tobytes()))
                piece, offset = piece + 1, offset + length
                texts[key][2] -= length
                if not texts[key][2]:
                    del texts[key]

        def batch_of() -> pa.RecordBatch:
            *numbers, ids = zip(*done, strict=True)
            columns = [pa.array(x, type=pa.int64()) for x in numbers]
            out = pa.record_batch([*columns, flat_binary(b"".join(ids), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))], names=[x.split()[0] for x in PLACED.split(", ")])
            done.clear()
            return out

        key = 0
        for batch in batches:
            for doc_id, ids in encoded(coder, batch, end_id, (4 if keep else 1) << 20):
                texts[key] = [doc_id, ids.copy(), len(ids)]
                for window in packer.add(key, 0, len(ids)):
                    put(window, part << GROUP | sequence)
                    sequence += 1
                key += 1
                if len(done) >= 2000:
                    yield batch_of()
        if not keep:
            coder.clear()
        release_memory()
        for k, window in enumerate(packer.open):
            put(window, -1 - k)  # still open
        if done:
            yield batch_of()

    schema_of_moved = pa.schema([(x.split()[0], pa.int64()) for x in MOVED.split(", ")])

    def merge(last: bool, number: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            packer, out, sequence = Packer(size, open_windows, waste), [], 0
            base = number << ROUND | int(key[0].as_py()) << GROUP

            def put(window: list[tuple], name: int) -> None:
                offset = 0
                for (part, piece), start, length in window:
                    out.append((part, piece, start, length, int(key[0].as_py()), name, offset))
                    offset += length

            table = table.sort_by([(x, "ascending") for x in ("part", "piece", "sub_start")])
            rows = zip(*(table.column(x).to_pylist() for x in ("part", "piece", "sub_start", "length")), strict=True)
            for part, piece, start, length in rows:
                for window in packer.add((part, piece), start, length):
                    put(window, base | sequence)
                    sequence += 1
            if last:
                for window in packer.drain():
                    put(window, base | sequence)
                    sequence += 1
            for k, window in enumerate(packer.open):
                put(window, -1 - k)
            return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * len(schema_of_moved), schema=schema_of_moved)

        return run

    placed = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(place, PLACED), "placed", compression="zstd")
    is_open = F.col("sequence_id") < 0
    left = placed.where(is_open).select("part", "piece", F.lit(0).cast("long").alias("sub_start"), "length", F.col("part").alias("slot"))
    most = left.agg(F.max("slot")).first()[0]
    done, number = None, 0
    while most is not None:
        number += 1
        slots = most // group + 1
        moved = left.groupBy((F.col("slot") / group).cast("long").alias("to")).applyInArrow(merge(slots == 1, number), MOVED)
        moved = scratch.save(moved, f"moved{number}")
        closed = moved.where(~is_open)
        done = closed if done is None else done.unionByName(closed)
        if slots == 1:
            break
        left, most = moved.where(is_open).select("part", "piece", "sub_start", "length", "slot"), slots - 1
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = placed.where(~is_open).select(columns)
    if done is None:
        return kept
    opened = placed.where(is_open).select("part", "piece", "doc_id", "start", "doc_tokens", "ids")
    merged = opened.join(done.drop("slot"), ["part", "piece"]).withColumns({"start": F.col("start") + F.col("sub_start"), "ids": F.expr("substring(ids, cast(sub_start * 4 + 1 as int), cast(length * 4 as int))")})
    return kept.unionByName(merged.select(columns))
