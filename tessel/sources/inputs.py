"""Inputs: generators that don't depend on partitioning, and tables derived from star-schema Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.grid import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(i: Column, j: Column, seed: int, modulus: int) -> Column:
    """A value in [0, modulus) from (seed, i, j) in plain integer arithmetic, the same in any engine."""
    x = (i.cast("long") * 7919 + j.cast("long") * 104729 + seed * 1299709 + 12345) % 2147483647
    return (x * 48271 % 2147483647 * 69621 % 2147483647) % modulus


def random_cells(spark: SparkSession, n: int, kind: str, seed: int = 30) -> DataFrame:
    """i, j, v: weights in [1, 10] without loops (graph), entries in [1, 100] with a dominant diagonal (matrix), zeros on and above the diagonal (folding)."""
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    cells = i.select("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    if kind == "graph":
        return cells.where("i <> j").withColumn("v", 1 + mixed(F.col("i"), F.col("j"), seed, 9001) / 1000)
    if kind == "matrix":
        return cells.withColumn("v", 1 + mixed(F.col("i"), F.col("j"), seed, 9901) / 100 + F.when(F.col("i") == F.col("j"), 101.0 * n).otherwise(0.0))
    if kind == "folding":
        return cells.where("i <= j").withColumn("v", F.lit(0.0))
    raise ValueError(f"kind is graph, matrix or folding, not {kind!r}")


def random_sequence(spark: SparkSession, n: int, seed: int, letters: str = "ABCD") -> DataFrame:
    """pos, ch: a sequence of n letters; places count from 1."""
    place = mixed(F.col("id"), F.lit(0), seed, len(letters))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("pos"), F.substring(F.lit(letters), place.cast("int") + 1, F.lit(1)).alias("ch"))


def block_census(spark: SparkSession, n: int, r: int, upper: bool = False) -> DataFrame:
    """bi, bj and the number of cells of each block, counted from the indices."""
    grid = Grid(n, r)
    side = spark.range(n).groupBy(grid.block_of(F.col("id")).alias("b")).agg(F.count("*").alias("n"))
    one, two = side.select(F.col("b").alias("bi"), F.col("n").alias("rows")), side.select(F.col("b").alias("bj"), F.col("n").alias("cols"))
    both = one.join(two, F.col("bi") <= F.col("bj")) if upper else one.join(two)
    return both.select("bi", "bj", (F.col("rows") * F.col("cols")).alias("cells"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, n, q: lineitems from suppliers of nation i to customers of nation j, and their quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    # quantities by order and supplier's nation first, so that orders meet the fewest rows
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("i"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("j"))
    joined = items.join(suppliers, "l_suppkey").join(orders.join(customers, "c_custkey"), "l_orderkey")
    return joined.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w of the nation graph; the toll of a route is its traded quantity modulo 97, plus 1."""
    return trade(spark, sf_dir).where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), (1 + F.col("q") % 97).alias("w"))


def nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, v: lineitems between nations, with each row's sum and one more on its diagonal, so no pivot comes near 0."""
    counts = trade(spark, sf_dir).select("i", "j", "n")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    pairs = nations.crossJoin(nations.select(F.col("i").alias("j")))
    full = pairs.join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy("i"))
    return full.select("i", "j", (F.col("n") + F.when(F.col("i") == F.col("j"), total + 1).otherwise(0)).cast("double").alias("v"))


def gram_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, v: inner products of the embeddings' dimensions over all vectors, in thousandths, plus a ridge."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double") * 1000).cast("long").alias("x"))
    pairs = long.join(long.select("vec_id", F.col("i").alias("j"), F.col("x").alias("y")), "vec_id")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).select("i", "j", (F.col("s") / 1e6 + F.when(F.col("i") == F.col("j"), 100.0).otherwise(0.0)).alias("v"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, h: for each dimension of the embeddings, whether it is positive in at least half of all vectors."""
    return table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg((2 * F.sum((F.col("x") > 0).cast("int")) >= F.count("*")).cast("int").alias("h"))


def contact_matrix(chain: DataFrame) -> DataFrame:
    """j, k, c: contacts of the chain folded behind j, up to k (j + 2 <= k < n, 1 <= j): places t <= min(k, 2j) that meet 2j - t - 1, both 1."""
    n = chain.count()
    ones = chain.where("h = 1")
    t, q = ones.select(F.col("pos").alias("t")), ones.select(F.col("pos").alias("q"))
    # t meets q at j = (t + q + 1) / 2
    meet = t.join(q, (F.col("q") < F.col("t")) & ((F.col("t") + F.col("q")) % 2 == 1))
    meet = meet.select(((F.col("t") + F.col("q") + 1) / 2).cast("int").alias("j"), F.col("t").alias("k")).where("k >= j + 2 and k <= 2 * j").withColumn("hit", F.lit(1))
    places = chain.select(F.col("pos").alias("j")).where((F.col("pos") >= 1) & (F.col("pos") < n - 1)).select("j", F.explode(F.sequence(F.col("j") + 1, F.lit(n - 1))).alias("k")).where("k >= j + 2")
    running = W.partitionBy("j").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return places.join(meet, ["j", "k"], "left").select("j", "k", F.sum(F.coalesce("hit", F.lit(0))).over(running).cast("long").alias("c"))


def _leaders(counted: DataFrame) -> DataFrame:
    """pos, ch: the initial of the name with the highest count at each place; ties take the first name."""
    return counted.groupBy("pos").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name")).select("pos", F.substring("name", 1, 1).alias("ch"))


def sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sequences over market segments: each nation's leading segment by customers, and by orders. Places count from 1."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("pos"), F.col("c_mktsegment").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = customers.groupBy("pos", "name").agg(F.count("*").alias("n"))
    two = customers.join(orders, "c_custkey").groupBy("pos", "name").agg(F.count("*").alias("n"))
    return _leaders(one), _leaders(two)


def edges_from(spark: SparkSession, path: str, source_format: str = "parquet", **options: str) -> DataFrame:
    """src, dst, w from a file of edges in any format Spark reads."""
    return spark.read.format(source_format).options(**options).load(path).select(F.col("src").cast("int"), F.col("dst").cast("int"), "w")


def matrix_rows(cells: DataFrame, missing: str = "-") -> DataFrame:
    """i, line: the values of each row of a table in order of their columns; `missing` where there is no cell."""
    high = cells.agg(F.max("j")).first()[0] or 0
    row = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", F.col("v").cast("string")))).alias("m"))
    return row.select("i", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(high)), lambda j: F.coalesce(F.col("m")[j], F.lit(missing))), " ").alias("line"))


def write(df: DataFrame, path: str, sink_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Cells, blocks or edges to a file; text takes one line a row, as JSON."""
    if sink_format == "text":
        df = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    df.write.format(sink_format).mode(mode).save(path)
