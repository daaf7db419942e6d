"""The grid of blocks over an n x n table, and where its blocks are placed."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEMENTS = ("ph", "md", "cus")


@dataclass(frozen=True)
class Grid:
    """n indices in r blocks of equal size; the last may be smaller."""

    n: int
    r: int

    def __post_init__(self):
        if self.n < 1 or self.r < 1:
            raise ValueError(f"a grid needs n >= 1 and r >= 1, not n={self.n}, r={self.r}")
        object.__setattr__(self, "r", -(-self.n // self.block))

    @property
    def block(self) -> int:
        return -(-self.n // self.r)

    def size(self, k: int) -> int:
        return min(self.block, self.n - k * self.block)

    def size_of(self, k: Column) -> Column:
        return F.least(F.lit(self.block), F.lit(self.n) - k * self.block).cast("int")

    def block_of(self, index: Column) -> Column:
        return F.floor(index / self.block).cast("int")


def diagonal_major(r: int, a: Column, b: Column) -> Column:
    """Multi-diagonal number of a block: along the main diagonal first, then each next one; (i, j) and (j, i) share it."""
    low, d = F.least(a, b), F.abs(a - b)
    return (low + d * F.lit(2 * r + 1) / 2 - d * d / 2).cast("int")


def executor_grid(r: int, nodes: int, a: Column, b: Column) -> Column:
    """Number of a block on a square grid of executors, each with a square batch of blocks."""
    side = max(1, math.isqrt(nodes))
    batch = max(1, r // side)
    return (F.floor(a / batch) * side + F.floor(b / batch)).cast("int")


def place(df: DataFrame, placement: str, partitions: int, grid: Grid, nodes: int = 1) -> DataFrame:
    """Blocks dealt to partitions: by hash (ph), by multi-diagonal (md) or by executor grid (cus)."""
    if placement == "ph":
        return df.repartition(partitions, "bi", "bj")
    if placement == "md":
        number = diagonal_major(grid.r, F.col("bi"), F.col("bj"))
    elif placement == "cus":
        number = executor_grid(grid.r, nodes, F.col("bi"), F.col("bj"))
    else:
        raise ValueError(f"placement is one of {', '.join(PLACEMENTS)}, not {placement!r}")
    return df.repartitionById(partitions, F.pmod(number, F.lit(partitions)))
