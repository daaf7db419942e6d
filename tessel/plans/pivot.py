"""The pivot loop on tables of blocks, with shuffled or broadcast operands."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.grid import Grid, place
from tessel.operators.blocks import apply_kernel, operand
from tessel.plans.options import SolveOptions
from tessel.plans.recurrence import Recurrence
from tessel.sources.scratch import Scratch


class Keeper:
    """Writes intermediate tables, caches them if the options say so, and lets go of those that are done with."""

    LEVELS = {"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}

    def __init__(self, df: DataFrame, options: SolveOptions, name: str):
        self.level, self.scratch, self.kept = self.LEVELS.get(options.persist), Scratch(df.sparkSession, name), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept[name] = df = self.scratch.save(df, name)
        return df.persist(self.level) if self.level else df

    def drop(self, name: str) -> None:
        if self.level:
            self.kept[name].unpersist()
        self.scratch.drop(name)


def met(df: DataFrame, other: DataFrame, on: str, options: SolveOptions, size: int) -> DataFrame:
    """Blocks with an operand of at most `size` bytes: broadcast if the strategy and that bound allow it, else shuffled."""
    small = options.strategy == "broadcast" and size <= options.broadcast_bytes
    return df.join(F.broadcast(other) if small else other.hint("merge"), on)


def pivot_step(table: DataFrame, k: int, recurrence: Recurrence, grid: Grid, options: SolveOptions, keeper: Keeper) -> DataFrame:
    """The table after pivot k."""
    roles, kernels = recurrence.roles(k), recurrence.kernels(grid, k)
    one = 8 * grid.block**2
    a = apply_kernel(table.where(roles["A"]), kernels["A"], [])
    cross = [a]
    for role in ("B", "C"):
        if role in roles:
            key = "bi" if role == "B" and not recurrence.folds else "bj"
            blocks = met(table.where(roles[role]), operand(a, "a", **{key: key}), key, options, one)
            cross.append(apply_kernel(blocks, kernels[role], ["a"]))
    cross = keeper.keep(reduce(DataFrame.unionByName, cross), f"cross{k}")
    rest = table.where(roles["D"])
    if recurrence.folds:
        below = operand(cross, "v", below="bi")
        rest = met(rest, operand(cross, "u", bj="bi"), "bj", options, one * grid.r)
        rest = met(rest.withColumn("below", F.col("bj") + 1), below, "below", options, one * grid.r)
    else:
        rest = met(rest, operand(cross.where(F.col("bj") == k), "u", bi="bi"), "bi", options, one * grid.r)
        rest = met(rest, operand(cross.where(F.col("bi") == k), "v", bj="bj"), "bj", options, one * grid.r)
    rest = apply_kernel(rest, kernels["D"], ["u", "v"])
    done = table.where(~reduce(lambda x, y: x | y, roles.values()))
    out = cross.unionByName(rest).unionByName(done)
    if options.partitions:
        out = place(out, options.placement, options.partitions, grid, options.nodes)
    return out


def run_pivots(blocks: DataFrame, recurrence: Recurrence, grid: Grid, options: SolveOptions) -> DataFrame:
    """The table after all pivots. Each pivot's table is kept and the one before it dropped."""
    keeper = Keeper(blocks, options, recurrence.name)
    table = keeper.keep(blocks, "start")
    names = ["start"]
    for k in recurrence.pivots(grid):
        table = keeper.keep(pivot_step(table, k, recurrence, grid, options, keeper), f"pivot{k}")
        for name in [*names, f"cross{k}"]:
            keeper.drop(name)
        names = [f"pivot{k}"]
    return table
