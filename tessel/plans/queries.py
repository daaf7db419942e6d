"""The queries of the solver over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grid import Grid, diagonal_major, executor_grid, place
from tessel.functions.kernels import stub_weight
from tessel.operators.blocks import block_keys
from tessel.plans import recurrence, solve
from tessel.plans.cells import minplus_step
from tessel.plans.options import SolveOptions
from tessel.sources import inputs
from tessel.sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def distances(**options) -> Query:
    return lambda spark, sf: solve.shortest_paths(inputs.nation_edges(spark, sf), nations(spark, sf), SolveOptions(**options))


def nations(spark: SparkSession, sf: str) -> int:
    return int(inputs.table(spark, sf, "nation").agg(F.max("n_nationkey")).first()[0]) + 1


def minplus(spark: SparkSession, sf: str) -> DataFrame:
    edges = inputs.nation_edges(spark, sf).toDF("i", "j", "v")
    return minplus_step(edges, edges)


def region_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths that stay in one region: the closure of each diagonal block of nations grouped by region."""
    region = inputs.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    edges = inputs.nation_edges(spark, sf)
    edges = edges.join(region.toDF("src", "a"), "src").join(region.toDF("dst", "b"), "dst").where("a = b")
    return solve.shortest_paths(edges.select("src", "dst", "w"), nations(spark, sf), SolveOptions(grid=5))


def packed(spark: SparkSession, sf: str, **options) -> DataFrame:
    return solve.factors(inputs.nation_matrix(spark, sf), nations(spark, sf), SolveOptions(**options))


def rounded(df: DataFrame, column: str = "v", digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + 0.0)


def upper(**options) -> Query:
    return lambda spark, sf: rounded(solve.eliminated(packed(spark, sf, **options)))


def lower(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(solve.lower(packed(spark, sf)))


def determinant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(solve.determinant(packed(spark, sf)), "log10_abs")


def gram_determinant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(solve.determinant(solve.factors(inputs.gram_cells(spark, sf), None, SolveOptions(grid=4, kernel="tiled", base_size=8))), "log10_abs")


def system(spark: SparkSession, sf: str) -> DataFrame:
    right = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1).cast("double").alias("b"))
    return rounded(solve.solve_system(inputs.nation_matrix(spark, sf), right, nations(spark, sf)), "x")


def literal(spark: SparkSession, sf: str) -> DataFrame:
    return solve.literal_triangle(inputs.nation_matrix(spark, sf))


def whole(df: DataFrame) -> DataFrame:
    return df.select("i", "j", F.col("v").cast("long").alias("v"))


def folded(contact: bool, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        chain = inputs.protein(spark, sf)
        return whole(solve.fold_protein(spark, chain.count(), chain if contact else None, SolveOptions(**options)))

    return run


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.contact_matrix(inputs.protein(spark, sf))


def score(spark: SparkSession, sf: str) -> DataFrame:
    return solve.fold_score(folded(True)(spark, sf))


def alignment(spark: SparkSession, sf: str) -> DataFrame:
    return whole(solve.align_cells(*inputs.sequences(spark, sf), SolveOptions(grid=4)))


def alignment_cost(spark: SparkSession, sf: str) -> DataFrame:
    return alignment(spark, sf).agg(F.max_by("v", F.struct("i", "j")).alias("cost"))


def placed(placement: str) -> Query:
    grid = Grid(70, 7)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        keys = block_keys(spark, grid).select("bi", "bj")
        if placement == "ph":
            # Spark's hash isn't part of the result: keys stay whole, and equal ones are in one of the partitions
            both = place(keys.unionByName(keys), "ph", 5, grid).withColumn("part", F.spark_partition_id())
            return both.groupBy("bi", "bj").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), (F.max("part") < 5).alias("inside"))
        number = diagonal_major(grid.r, F.col("bi"), F.col("bj")) if placement == "md" else executor_grid(grid.r, 9, F.col("bi"), F.col("bj"))
        return place(keys, placement, 64, grid, 9).select("bi", "bj", number.alias("number"), F.spark_partition_id().alias("part"))

    return run


def census(upper: bool) -> Query:
    return lambda spark, sf: inputs.block_census(spark, 50, 6, upper)


def double_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Over weights that aren't whole, by squaring cells."""
    edges = inputs.nation_edges(spark, sf).withColumn("w", F.col("w") / 7)
    return rounded(solve.shortest_paths(edges, nations(spark, sf), SolveOptions(strategy="cells")))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.random_sequence(spark, 60, 30).withColumn("seed", F.lit(30)).unionByName(inputs.random_sequence(spark, 60, 31).withColumn("seed", F.lit(31)))


def printed(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.matrix_rows(inputs.nation_edges(spark, sf).toDF("i", "j", "v"))


def values(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [inputs.random_cells(spark, 40, kind).select(F.lit(kind).alias("kind"), "i", "j", "v") for kind in ("graph", "matrix", "folding")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """problem, k, role and the number of blocks in that role; DONE are those a pivot leaves alone."""
    grid, out = Grid(60, 6), None
    for rule in (recurrence.shortest_paths(), recurrence.elimination(), recurrence.folding(stub_weight)):
        blocks = block_keys(spark, grid, rule.upper).join(spark.range(grid.r).select(F.col("id").cast("int").alias("k")))
        role = F.lit("DONE")
        for name, test in rule.roles(F.col("k")).items():
            role = F.when(test, name).otherwise(role)
        one = blocks.groupBy(F.lit(rule.name).alias("problem"), "k", role.alias("role")).agg(F.count("*").alias("blocks"))
        out = one if out is None else out.unionByName(one)
    return out


def fanout(spark: SparkSession, sf: str) -> DataFrame:
    """problem, k and how many blocks take the pivot block, and how many operands the rest takes from its row and column."""
    counts = stages(spark, sf).groupBy("problem", "k")
    take = lambda *roles: F.sum(F.when(F.col("role").isin(*roles), F.col("blocks")).otherwise(0))
    return counts.agg(take("B", "C").alias("pivot_uses"), (2 * take("D")).alias("cross_uses"))


def roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = Scratch(spark, "sink").path("distances")
    inputs.write(distances()(spark, sf), path)
    return spark.read.parquet(path)


QUERIES: dict[str, Query] = {
    "fw_apsp_cells": distances(strategy="cells"),
    "fw_apsp_auto": distances(),
    "fw_apsp_shuffle": distances(strategy="shuffle", grid=4),
    "fw_apsp_broadcast": distances(strategy="broadcast", grid=5),
    "fw_apsp_tiled": distances(kernel="tiled", base_size=3, r_shared=3, grid=3),
    "fw_apsp_md": distances(placement="md", partitions=6, grid=4),
    "fw_apsp_cus": distances(placement="cus", partitions=4, nodes=4, persist="disk", grid=3),
    "fw_apsp_double": double_distances,
    "fw_minplus_step": minplus,
    "fw_region_closure": region_closure,
    "ge_upper_cells": upper(strategy="cells"),
    "ge_upper_shuffle": upper(strategy="shuffle", grid=4),
    "ge_upper_broadcast": upper(strategy="broadcast", grid=5),
    "ge_upper_tiled": upper(kernel="tiled", base_size=2, r_shared=2, grid=3),
    "ge_lower": lower,
    "ge_det": determinant,
    "ge_gram_det": gram_determinant,
    "ge_solve": system,
    "ge_literal_triu": literal,
    "paf_stub_cells": folded(False, strategy="cells"),
    "paf_stub_shuffle": folded(False, strategy="shuffle", grid=4),
    "paf_stub_broadcast": folded(False, grid=5),
    "paf_stub_tiled": folded(False, kernel="tiled", base_size=5, r_shared=3, grid=2),
    "paf_contact_tiled": folded(True, kernel="tiled", base_size=4, r_shared=2, grid=3),
    "paf_contact_cells": folded(True, strategy="cells"),
    "paf_contact_shuffle": folded(True, strategy="shuffle", grid=3),
    "paf_contact_broadcast": folded(True, grid=4),
    "paf_contact_matrix": contacts,
    "paf_score": score,
    "gap_align": alignment,
    "gap_cost": alignment_cost,
    "part_ph": placed("ph"),
    "part_md": placed("md"),
    "part_cus": placed("cus"),
    "src_square": census(False),
    "src_upper": census(True),
    "src_values": values,
    "src_sequences": sequences,
    "sink_matrix": printed,
    "stage_census": stages,
    "fanout_census": fanout,
    "sink_roundtrip": roundtrip,
}
