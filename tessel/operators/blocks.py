"""Tables of dense blocks: conversion from and to cells, and kernels over joined blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grid import Grid

BLOCK = "bi int, bj int, rows int, cols int, data array<double>"
KEYS = ["bi", "bj", "rows", "cols"]


def block_keys(spark: SparkSession, grid: Grid, upper: bool = False) -> DataFrame:
    """bi, bj, rows, cols of all blocks, or of those on and above the diagonal."""
    side = spark.range(grid.r).select(F.col("id").cast("int").alias("bi"))
    keys = side.select("bi", F.explode(F.sequence(F.col("bi") if upper else F.lit(0), F.lit(grid.r - 1))).alias("bj"))
    return keys.select("bi", "bj", grid.size_of(F.col("bi")).alias("rows"), grid.size_of(F.col("bj")).alias("cols"))


def to_blocks(cells: DataFrame, grid: Grid, missing: float, diagonal: float | None = None, upper: bool = False) -> DataFrame:
    """Blocks from cells (i, j, v); absent cells are `missing`, or `diagonal` on the diagonal.

    Cells are packed where they are gathered, a block at a time; a key that occurs twice is an error.
    """
    block = grid.block
    keyed = cells.select(grid.block_of(F.col("i")).alias("bi"), grid.block_of(F.col("j")).alias("bj"), (F.col("i") % block).cast("int").alias("a"), (F.col("j") % block).cast("int").alias("b"), F.col("v").cast("double").alias("v"))
    if upper:
        keyed = keyed.where("bi <= bj")
    packed = keyed.groupBy("bi", "bj").agg(F.collect_list(F.struct("a", "b", "v")).alias("cells"))
    full = block_keys(cells.sparkSession, grid, upper).join(packed, ["bi", "bj"], "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bi, bj, rows, cols, cell_list in zip(*(batch.column(k) for k in range(5)), strict=True):
                x = np.full((rows.as_py(), cols.as_py()), missing)
                if diagonal is not None and bi.as_py() == bj.as_py():
                    np.fill_diagonal(x, diagonal)
                if cell_list.is_valid:
                    a, b, v = (cell_list.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    if len(a) != len(set(zip(a.tolist(), b.tolist(), strict=True))):
                        raise ValueError("a cell occurs more than once")
                    x[a, b] = v
                out.append(x)
            yield _batch(batch, out)

    return full.mapInArrow(fill, BLOCK)


def to_cells(blocks: DataFrame, grid: Grid) -> DataFrame:
    """i, j, v of every cell."""
    at = blocks.select("bi", "bj", "cols", F.posexplode("data").alias("k", "v"))
    i = F.col("bi") * grid.block + F.floor(F.col("k") / F.col("cols"))
    j = F.col("bj") * grid.block + F.col("k") % F.col("cols")
    return at.select(i.cast("int").alias("i"), j.cast("int").alias("j"), "v")


def _batch(like: pa.RecordBatch, blocks: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([x.size for x in blocks])]).astype(np.int32)
    data = np.concatenate([x.ravel() for x in blocks]) if blocks else np.zeros(0)
    return pa.record_batch([*(like.column(x) for x in KEYS), pa.ListArray.from_arrays(pa.array(offsets), pa.array(data, type=pa.float64()))], names=[*KEYS, "data"])


def apply_kernel(joined: DataFrame, kernel: Callable[..., np.ndarray], operands: list[str]) -> DataFrame:
    """New blocks from rows that hold a block and its operands.

    kernel(bi, bj, x, *operands) gets a writable block; an operand is an array column with the
    operand's rows and columns beside it in <name>_rows and <name>_cols, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(len(batch)):
                args = []
                for name, rows, cols in [("data", "rows", "cols"), *((x, f"{x}_rows", f"{x}_cols") for x in operands)]:
                    value = batch.column(name)[k]
                    args.append(np.array(value.values, dtype=float).reshape(batch.column(rows)[k].as_py(), batch.column(cols)[k].as_py()) if value.is_valid else None)
                out.append(kernel(batch.column("bi")[k].as_py(), batch.column("bj")[k].as_py(), *args))
            yield _batch(batch, out)

    needed = [*KEYS, "data", *(y for x in operands for y in (x, f"{x}_rows", f"{x}_cols"))]
    return joined.select(needed).mapInArrow(run, BLOCK)


def operand(blocks: DataFrame, name: str, **keys: str) -> DataFrame:
    """Blocks as an operand column `name`, with key columns renamed: operand(b, "u", row="bi")."""
    return blocks.select(*(F.col(old).alias(new) for new, old in keys.items()), F.col("data").alias(name), F.col("rows").alias(f"{name}_rows"), F.col("cols").alias(f"{name}_cols"))
