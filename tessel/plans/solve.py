"""The solver: problems on DataFrames of edges, cells and sequences.

    python -m tessel.plans.solve --problem fw --input edges.parquet --output distances.parquet
"""

from __future__ import annotations

import argparse
import logging
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grid import PLACEMENTS, Grid
from tessel.functions.kernels import contact_weight, stub_weight
from tessel.operators.blocks import block_keys, to_blocks, to_cells
from tessel.plans import recurrence
from tessel.plans.cells import closure_cells, eliminate_cells, fold_cells
from tessel.plans.options import KERNELS, PERSIST, PROBLEMS, STRATEGIES, SolveOptions
from tessel.plans.pivot import run_pivots
from tessel.plans.wavefront import align_sequences, aligned_cells, letters
from tessel.sources import inputs
from tessel.sources.scratch import Scratch

log = logging.getLogger(__name__)
DEFAULT = SolveOptions()


def order_of(cells: DataFrame, n: int | None) -> int:
    """The size of a square table, given or read off its cells; indices outside it are an error."""
    low, high = cells.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j"))).first()
    if low is not None and low < 0 or n is not None and high is not None and high >= n:
        raise ValueError(f"indices run from {low} to {high}, outside a table of {n}")
    return n if n is not None else 1 if high is None else int(high) + 1


def shortest_paths(edges: DataFrame, n: int | None = None, options: SolveOptions = DEFAULT) -> DataFrame:
    """i, j, v for every pair that a path joins, with 0 from each vertex to itself.

    edges: src, dst, w. A weight of 0 is an edge, of parallel edges the least counts, a null weight
    is no edge. A negative cycle raises ValueError.
    """
    kind, scratch = dict(edges.dtypes)["w"], Scratch(edges.sparkSession, "edges")
    cells = edges.where("w is not null").groupBy(F.col("src").cast("int").alias("i"), F.col("dst").cast("int").alias("j")).agg(F.min("w").alias("v"))
    cells = scratch.save(cells, "cells")  # the input is read once
    n = order_of(cells, n)
    if not cells.where("i = j and v < 0").isEmpty():
        raise ValueError("the graph has a negative cycle")
    own = cells.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0).cast(kind).alias("v"))
    cells = cells.where("i <> j")
    if options.strategy == "cells":
        return closure_cells(cells.unionByName(own), n).select("i", "j", "v")
    grid, rule = options.grid_of(n), recurrence.shortest_paths(options.tiling)
    found = to_cells(run_pivots(to_blocks(cells, grid, rule.missing, rule.diagonal), rule, grid, options), grid)
    if not found.where("i = j and v < 0").isEmpty():
        raise ValueError("the graph has a negative cycle")
    return found.where(F.col("v") < float("inf")).select("i", "j", F.col("v").cast(kind).alias("v"))


def factors(cells: DataFrame, n: int | None = None, options: SolveOptions = DEFAULT) -> DataFrame:
    """i, j, v of the packed unpivoted factors: multipliers below the diagonal, the upper factor on and above it. Absent cells are 0."""
    cells = Scratch(cells.sparkSession, "cells").save(cells.select("i", "j", "v"), "cells")  # the input is read once
    n = order_of(cells, n)
    if options.strategy == "cells":
        grid = Grid(n, 1)
        return eliminate_cells(to_cells(to_blocks(cells, grid, 0.0), grid), n)
    grid, rule = options.grid_of(n), recurrence.elimination(options.tiling)
    return to_cells(run_pivots(to_blocks(cells, grid, rule.missing), rule, grid, options), grid)


def eliminated(packed: DataFrame) -> DataFrame:
    """The table after elimination: the upper factor, zeros below."""
    return packed.select("i", "j", F.when(F.col("i") <= F.col("j"), F.col("v")).otherwise(0.0).alias("v"))


def lower(packed: DataFrame) -> DataFrame:
    """The unit lower factor."""
    return packed.select("i", "j", F.when(F.col("i") > F.col("j"), F.col("v")).when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("v"))


def literal_triangle(cells: DataFrame) -> DataFrame:
    """What elimination gives that zeroes each multiplier before it is used: the upper triangle of the input."""
    return cells.select("i", "j", F.when(F.col("i") <= F.col("j"), F.col("v")).otherwise(0.0).alias("v"))


def determinant(packed: DataFrame) -> DataFrame:
    """One row: sign, and log10 of the determinant's size (null for 0)."""
    d = packed.where("i = j")
    return d.agg((1 - 2 * (F.sum((F.col("v") < 0).cast("int")) % 2)).cast("int").alias("sign"), F.sum(F.log10(F.abs("v"))).alias("log10_abs"))


def solve_system(cells: DataFrame, right: DataFrame, n: int | None = None, options: SolveOptions = DEFAULT) -> DataFrame:
    """i, x with A x = b. right: i, b. Two eliminations: of A beside b, then of the upper factor, its order reversed."""
    n = order_of(cells, n)
    spark = cells.sparkSession

    def beside(matrix: DataFrame, column: DataFrame) -> DataFrame:
        one = spark.range(1).select(F.lit(n).alias("i"), F.lit(n).alias("j"), F.lit(1.0).alias("v"))
        return matrix.select("i", "j", F.col("v").cast("double").alias("v")).unionByName(column.select("i", F.lit(n).alias("j"), F.col("b").cast("double").alias("v"))).unionByName(one)

    first = factors(beside(cells, right), n + 1, options).where((F.col("i") < n) & (F.col("i") <= F.col("j")))
    back = first.select((n - 1 - F.col("i")).alias("i"), F.when(F.col("j") == n, n).otherwise(n - 1 - F.col("j")).alias("j"), "v")
    second = factors(back.unionByName(spark.range(1).select(F.lit(n).alias("i"), F.lit(n).alias("j"), F.lit(1.0).alias("v"))), n + 1, options)
    ends = second.where((F.col("j") == n) & (F.col("i") < n)).select("i", F.col("v").alias("y"))
    return second.where((F.col("i") == F.col("j")) & (F.col("i") < n)).join(ends, "i").select((n - 1 - F.col("i")).cast("int").alias("i"), (F.col("y") / F.col("v")).alias("x"))


def fold_protein(spark: SparkSession, n: int, chain: DataFrame | None = None, options: SolveOptions = DEFAULT) -> DataFrame:
    """i, j, v (i <= j) of the folding table. chain: pos, h gives contact weights; without it a weight is row + column."""
    if options.strategy == "cells":
        start = inputs.random_cells(spark, n, "folding")
        if chain is None:
            return fold_cells(start, n, weight=lambda a, b: a + b)
        return fold_cells(start, n, contacts=inputs.contact_matrix(chain))
    if chain is None:
        weight = stub_weight
    else:
        rows = sorted(chain.collect())  # one small number for each of the table's n rows
        weight = contact_weight(np.array([r.h for r in rows]))
    grid, rule = options.grid_of(n), recurrence.folding(weight, options.tiling)
    keys = block_keys(spark, grid, upper=True)
    blocks = keys.select("*", F.array_repeat(F.lit(0.0), F.col("rows") * F.col("cols")).alias("data"))
    return to_cells(run_pivots(blocks, rule, grid, options), grid).where("i <= j")


def fold_score(folded: DataFrame) -> DataFrame:
    """One row: the best score, the most in row 0."""
    return folded.where("i = 0").agg(F.max("v").alias("score"))


def align_cells(x: DataFrame, y: DataFrame, options: SolveOptions = DEFAULT) -> DataFrame:
    """i, j, v of the alignment table of two sequences (pos from 1, ch)."""
    return aligned_cells(*align_sequences(x.sparkSession, letters(x), letters(y), options))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--problem", choices=PROBLEMS, required=True)
    p.add_argument("--strategy", choices=STRATEGIES, default=DEFAULT.strategy)
    p.add_argument("--grid", type=int, default=DEFAULT.grid, help="blocks on a side; 0: by size")
    p.add_argument("--persist", choices=PERSIST, default=DEFAULT.persist)
    p.add_argument("--kernel", choices=KERNELS, default=DEFAULT.kernel)
    p.add_argument("--r-shared", type=int, default=DEFAULT.r_shared, help="tiles on a side of a tiled block")
    p.add_argument("--base-size", type=int, default=DEFAULT.base_size, help="rows below which a tile isn't cut")
    p.add_argument("--partitions", type=int, default=0)
    p.add_argument("--placement", choices=PLACEMENTS, default=DEFAULT.placement)
    p.add_argument("--nodes", type=int, default=1, help="executors, for placement cus")
    p.add_argument("--n", type=int, help="size of the table; for generated input, or to check the input against")
    p.add_argument("--input", help="edges (src, dst, w), cells (i, j, v), a chain (pos, h) or a sequence (pos, ch); generated without it")
    p.add_argument("--second", help="the other sequence, for gap")
    p.add_argument("--output", help="Parquet folder for the result; without it the result is counted")
    p.add_argument("--print", action="store_true", help="print the table, a line for each row")
    p.add_argument("--event-log", help="folder for Spark's event log")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    options = SolveOptions(strategy=a.strategy, grid=a.grid, kernel=a.kernel, r_shared=a.r_shared, base_size=a.base_size, partitions=a.partitions, placement=a.placement, nodes=a.nodes, persist=a.persist)
    builder = SparkSession.builder.appName(f"tessel-{a.problem}")
    if a.event_log:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.event_log)
    spark = builder.getOrCreate()
    if not a.input and a.n is None or a.problem == "gap" and bool(a.input) != bool(a.second):
        p.error("give --input, or --n for generated input; gap takes --input and --second, or neither")
    began = time.monotonic()
    given = spark.read.parquet(a.input) if a.input else None
    if a.problem == "fw":
        edges = given if given is not None else inputs.random_cells(spark, a.n, "graph").toDF("src", "dst", "w")
        out = shortest_paths(edges, a.n, options)
    elif a.problem == "ge":
        out = eliminated(factors(given if given is not None else inputs.random_cells(spark, a.n, "matrix"), a.n, options))
    elif a.problem == "paf":
        out = fold_protein(spark, a.n or given.count(), given, options)
    else:
        pair = (given, spark.read.parquet(a.second)) if a.input else (inputs.random_sequence(spark, a.n, 30), inputs.random_sequence(spark, a.n, 31))
        out = align_cells(*pair, options)
    if a.print:
        for row in inputs.matrix_rows(out).orderBy("i").toLocalIterator():
            print(row.line)
    if a.output:
        inputs.write(out, a.output)
    elif not a.print:
        log.info("cells: %d", out.count())
    log.info("time to solution: %.3f s", time.monotonic() - began)


if __name__ == "__main__":
    main()
