"""The recurrences as plain Catalyst plans on cells: joins and aggregations, one kept table a step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.scratch import Scratch


def minplus_step(one: DataFrame, two: DataFrame) -> DataFrame:
    """i, j, v: the least one.v + two.v over a shared middle index."""
    a, b = one.select("i", F.col("j").alias("m"), F.col("v").alias("x")), two.select(F.col("i").alias("m"), "j", F.col("v").alias("y"))
    return a.join(b, "m").groupBy("i", "j").agg(F.min(F.col("x") + F.col("y")).alias("v"))


def closure_cells(cells: DataFrame, n: int) -> DataFrame:
    """Shortest paths among n vertices by squaring; cells must hold the diagonal.

    Ends after as many squarings as paths of n steps need, at the latest; before that when a squaring
    changes no cell (known by a sum over hashes of all cells, as sums of values can hide a change), or
    shows a negative cycle.
    """
    scratch, most = Scratch(cells.sparkSession, "closure"), max(1, n).bit_length()
    now, state = scratch.save(cells, "step0"), None
    for step in range(most + 1):
        if step:
            now = scratch.save(minplus_step(now, now), f"step{step}")
            scratch.drop(f"step{step - 1}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("i", "j", "v").cast("decimal(38,0)")), F.min(F.when(F.col("i") == F.col("j"), F.col("v")))).first()
        if new[2] is not None and new[2] < 0:
            raise ValueError("the graph has a negative cycle")
        if new == state:
            break
        state = new
    return now


def eliminate_cells(cells: DataFrame, n: int) -> DataFrame:
    """Packed unpivoted factors, a step for each pivot; operands are the pivot's row and column (n cells each)."""
    scratch = Scratch(cells.sparkSession, "eliminate")
    now = scratch.save(cells.select("i", "j", F.col("v").cast("double").alias("v")), "step")
    for k in range(n - 1):
        row = now.where((F.col("i") == k) & (F.col("j") > k)).select("j", F.col("v").alias("q"))
        pivot = now.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("j"), F.col("v").alias("w"))
        column = now.where((F.col("j") == k) & (F.col("i") > k)).join(pivot, "j").select("i", (F.col("v") / F.col("w")).alias("l"))
        both = now.join(column, "i", "left").join(row, "j", "left")
        new = F.when((F.col("j") == k) & F.col("l").isNotNull(), F.col("l")).when(F.col("l").isNotNull() & F.col("q").isNotNull(), F.col("v") - F.col("l") * F.col("q")).otherwise(F.col("v"))
        now = scratch.save(both.select("i", "j", new.alias("v")), f"step{k}")
        scratch.drop(f"step{k - 1}" if k else "step")
    return now


def fold_cells(cells: DataFrame, n: int, weight: Callable[[Column, Column], Column] | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """Accordion folding, a step for each column k from the last; weights by an expression, or from a table j, k, c (absent: 0)."""
    scratch = Scratch(cells.sparkSession, "fold")
    now = scratch.save(cells, "step")
    last = "step"
    for k in range(n - 1, 2, -1):
        column = now.where(F.col("j") == k).select((F.col("i") - 1).alias("j"), F.col("v").alias("u"))
        live = (F.col("j") >= F.col("i") + 1) & (F.col("j") <= min(k - 2, n - 3)) & (F.col("i") <= n - 4)
        both = now.join(column, "j", "left").withColumns({"fj": F.col("j") + 1, "fk": F.least(F.lit(k), 2 * F.col("j") - F.col("i") + 1)})
        if contacts is None:
            both = both.withColumn("f", weight(F.col("fj"), F.col("fk")).cast("double"))
        else:
            both = both.join(contacts.select(F.col("j").alias("fj"), F.col("k").alias("fk"), F.col("c").cast("double").alias("f")), ["fj", "fk"], "left")
        new = F.when(live & F.col("u").isNotNull(), F.greatest("v", F.col("u") + F.coalesce("f", F.lit(0.0)))).otherwise(F.col("v"))
        now = scratch.save(both.select("i", "j", new.alias("v")), f"step{k}")
        scratch.drop(last)
        last = f"step{k}"
    return now
