"""Alignment with general gap costs: blocks in anti-diagonal waves.

G[i][j] = min(G[i-1][j-1] + (x_i <> y_j), min over q < j of G[i][q] + w(q, j), min over p < i of G[p][j] + w(p, i)).
A block needs all finished blocks of its row and of its column, and the corner before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grid import Grid
from tessel.functions.kernels import Gap, align, gap_from, sum_gap
from tessel.operators.blocks import BLOCK
from tessel.plans.options import SolveOptions
from tessel.sources.scratch import Scratch

SCHEMA = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))])


def letters(sequence: DataFrame) -> str:
    """A sequence pos, ch with places from 1 on, behind one unused place. It is as long as one side of the table."""
    rows = sequence.orderBy("pos").collect()
    if [r.pos for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError("places of a sequence count from 1 without gaps")
    return " " + "".join(r.ch for r in rows)


def align_sequences(spark: SparkSession, x: str, y: str, options: SolveOptions = SolveOptions(), gap: Gap = sum_gap) -> tuple[DataFrame, Grid, Grid]:  # noqa: B008
    """Blocks of the alignment table of x[1:] and y[1:], with the grids of its rows and columns."""
    down, across = options.grid_of(len(x)), options.grid_of(len(y))

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        i0, j0, n, m = bi * down.block, bj * across.block, down.size(bi), across.size(bj)
        best, top, left, corner = np.full((n, m), np.inf), np.full(m, np.inf), np.full(n, np.inf), np.inf
        for r in rows.to_pylist():
            if r["data"] is None:
                continue
            block = np.array(r["data"]).reshape(r["rows"], r["cols"])
            if r["fi"] == bi:
                np.minimum(best, gap_from(block, r["fj"] * across.block, j0 + np.arange(m), gap), out=best)
                if r["fj"] == bj - 1:
                    left = block[:, -1]
            elif r["fj"] == bj:
                np.minimum(best, gap_from(block.T.copy(), r["fi"] * down.block, i0 + np.arange(n), gap).T, out=best)
                if r["fi"] == bi - 1:
                    top = block[-1]
            else:
                corner = block[-1, -1]
        align(best, corner, top, left, i0, j0, x, y, gap)
        return pa.table([[bi], [bj], [n], [m], [best.ravel().tolist()]], schema=SCHEMA)

    scratch = Scratch(spark, "wavefront")
    done = None
    for wave in range(down.r + across.r - 1):
        low, high = max(0, wave - across.r + 1), min(wave, down.r - 1)
        targets = spark.range(low, high + 1).select(F.col("id").cast("int").alias("bi"), (F.lit(wave) - F.col("id")).cast("int").alias("bj"))
        empty = targets.select("bi", "bj", *(F.lit(None).cast("int").alias(c) for c in ("fi", "fj", "rows", "cols")), F.lit(None).cast("array<double>").alias("data"))
        if done is not None:
            source = done.select(F.col("bi").alias("fi"), F.col("bj").alias("fj"), "rows", "cols", "data")
            columns = ["bi", "bj", "fi", "fj", "rows", "cols", "data"]
            for on in (F.col("bi") == F.col("fi"), F.col("bj") == F.col("fj"), (F.col("bi") == F.col("fi") + 1) & (F.col("bj") == F.col("fj") + 1)):
                empty = empty.unionByName(source.join(targets, on).select(columns))
        wave_blocks = scratch.save(empty.groupBy("bi", "bj").applyInArrow(finish, BLOCK), f"wave{wave}")
        done = wave_blocks if done is None else done.unionByName(wave_blocks)
    return done, down, across


def aligned_cells(blocks: DataFrame, down: Grid, across: Grid) -> DataFrame:
    """i, j, v of every cell of an alignment table."""
    at = blocks.select("bi", "bj", "cols", F.posexplode("data").alias("k", "v"))
    i, j = F.col("bi") * down.block + F.floor(F.col("k") / F.col("cols")), F.col("bj") * across.block + F.col("k") % F.col("cols")
    return at.select(i.cast("int").alias("i"), j.cast("int").alias("j"), "v")
