import duckdb
import numpy as np
import pytest
from test_kernels import serial_fold, serial_paths, slow_contact

from tessel.functions.grid import Grid, place
from tessel.operators.blocks import block_keys, to_blocks, to_cells
from tessel.plans import solve
from tessel.plans.options import SolveOptions
from tessel.sources import inputs
from tessel.streaming.edges import paths_of_stream

OPTIONS = [
    SolveOptions(strategy="cells"),
    SolveOptions(strategy="shuffle", grid=3),
    SolveOptions(strategy="broadcast", grid=2, kernel="tiled", base_size=2, r_shared=2),
    SolveOptions(strategy="broadcast", broadcast_bytes=0, grid=5, placement="cus", partitions=4, nodes=4),
    SolveOptions(block_rows=4, persist="disk"),
    SolveOptions(strategy="shuffle", grid=1, persist="memory", placement="md", partitions=3),
]


def cells_of(x):
    return [(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(x.shape)]


def dense(df, n, missing=0.0):
    out = np.full((n, n), missing)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("options", OPTIONS)
def test_shortest_paths(spark, options):
    rng, n = np.random.default_rng(3), 11
    d = np.where(rng.random((n, n)) < 0.25, rng.integers(0, 30, (n, n)), np.inf).astype(float)
    d[8:, :8] = np.inf  # vertices that nothing reaches
    edges = [(i, j, int(d[i, j])) for i, j in np.ndindex(d.shape) if d[i, j] < np.inf]
    edges += [(i, j, w + 3) for i, j, w in edges[:9]] + [(0, 0, 5), (1, 2, None)]
    np.fill_diagonal(d, 0)
    got = solve.shortest_paths(spark.createDataFrame(edges, "src int, dst int, w long"), n, options)
    assert dict(got.dtypes) == {"i": "int", "j": "int", "v": "bigint"}
    assert (dense(got, n, np.inf) == serial_paths(d)).all()


@pytest.mark.parametrize("options", OPTIONS[:3])
def test_negative_cycles_are_errors(spark, options):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, -5), (2, 0, 1)], "src int, dst int, w long")
    with pytest.raises(ValueError, match="negative cycle"):
        solve.shortest_paths(edges, None, options)
    fine = spark.createDataFrame([(0, 1, 2), (1, 2, -2), (2, 0, 1)], "src int, dst int, w long")
    assert dense(solve.shortest_paths(fine, None, options), 3)[0, 2] == 0


@pytest.mark.parametrize("options", OPTIONS)
def test_elimination(spark, options):
    rng, n = np.random.default_rng(5), 7
    a = np.round(rng.random((n, n)) * 9) + 20 * np.eye(n)
    packed = solve.factors(spark.createDataFrame([c for c in cells_of(a) if c[2]], "i int, j int, v double"), n, options)
    x = dense(packed, n)
    low, up = dense(solve.lower(packed), n), dense(solve.eliminated(packed), n)
    assert np.allclose(low @ up, a)
    assert np.allclose(np.tril(x, -1) + np.eye(n), low)
    r = solve.determinant(packed).first()
    assert np.allclose(r.sign * 10**r.log10_abs, np.linalg.det(a))


def test_systems(spark):
    rng, n = np.random.default_rng(6), 6
    a, b = rng.random((n, n)) + 5 * np.eye(n), rng.random(n)
    got = solve.solve_system(spark.createDataFrame(cells_of(a), "i int, j int, v double"), spark.createDataFrame(list(enumerate(b.tolist())), "i int, b double"), n, OPTIONS[1])
    assert np.allclose([r.x for r in sorted(got.collect())], np.linalg.solve(a, b))


def test_a_multiplier_is_used_before_it_is_zeroed(spark):
    cells = spark.createDataFrame(cells_of(np.array([[2, 4], [6, 5.0]])), "i int, j int, v double")
    assert dense(solve.eliminated(solve.factors(cells, 2, OPTIONS[1])), 2).tolist() == [[2, 4], [0, -7]]
    assert dense(solve.literal_triangle(cells), 2).tolist() == [[2, 4], [0, 5]]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("contact", [False, True])
def test_folding(spark, options, contact):
    n = 13
    h = [int(k * 7 % 5 < 3) for k in range(n)]
    chain = spark.createDataFrame(list(enumerate(h)), "pos int, h int") if contact else None
    weight = (lambda j, k: slow_contact(h, j, k)) if contact else (lambda j, k: j + k)
    got = solve.fold_protein(spark, n, chain, options)
    assert (dense(got, n) == serial_fold(n, weight)).all()
    assert solve.fold_score(got).first().score == serial_fold(n, weight)[0].max()


def test_folding_reads_the_row_in_the_next_block(spark):
    got = dense(solve.fold_protein(spark, 8, None, SolveOptions(grid=2)), 8)
    assert (got[4, 5], got[2, 3]) == (13, 22)


def test_contact_matrix(spark):
    h = [1, 0, 1, 1, 1, 0, 1, 1, 0, 1]
    got = {(r.j, r.k): r.c for r in inputs.contact_matrix(spark.createDataFrame(list(enumerate(h)), "pos int, h int")).collect()}
    assert got == {(j, k): slow_contact(h, j, k) for j in range(1, 9) for k in range(j + 2, 10)}


def serial_align(x, y):
    g = np.full((len(x) + 1, len(y) + 1), np.inf)
    g[0, 0] = 0
    for i, j in np.ndindex(g.shape):
        if i and j:
            g[i, j] = min(g[i, j], g[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
        for q in range(j):
            g[i, j] = min(g[i, j], g[i, q] + q + j)
        for p in range(i):
            g[i, j] = min(g[i, j], g[p, j] + p + i)
    return g


@pytest.mark.parametrize("grid", [1, 2, 3, 9])
@pytest.mark.parametrize(("x", "y"), [("abcda", "abcda"), ("aabbc", "cab"), ("a", "bcdab")])
def test_alignment(spark, grid, x, y):
    tables = [spark.createDataFrame(list(enumerate(s, 1)), "pos int, ch string") for s in (x, y)]
    got = {(r.i, r.j): r.v for r in solve.align_cells(*tables, SolveOptions(grid=grid)).collect()}
    want = serial_align(x, y)
    assert got == {k: want[k] for k in np.ndindex(want.shape)}
    if x == y:
        assert all(got[k, k] == 0 for k in range(len(x) + 1))
    assert all(got[0, j] == j for j in range(len(y) + 1))


def test_gaps_in_places_are_errors(spark):
    bad = spark.createDataFrame([(1, "a"), (3, "b")], "pos int, ch string")
    with pytest.raises(ValueError):
        solve.align_cells(bad, bad)


def test_blocks_and_cells(spark):
    x = np.arange(35.0).reshape(5, 7)[:, :5]
    grid = Grid(5, 2)
    blocks = to_blocks(spark.createDataFrame(cells_of(x), "i int, j int, v double"), grid, 0.0)
    assert {(r.bi, r.bj, r.rows, r.cols) for r in blocks.collect()} == {(0, 0, 3, 3), (0, 1, 3, 2), (1, 0, 2, 3), (1, 1, 2, 2)}
    assert (dense(to_cells(blocks, grid), 5) == x).all()
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i int, j int, v double")
    with pytest.raises(Exception, match="more than once"):
        to_blocks(twice, grid, 0.0).collect()
    with pytest.raises(ValueError):
        solve.order_of(spark.createDataFrame([(0, 9, 1.0)], "i int, j int, v double"), 5)


def test_placement(spark):
    from pyspark.sql import functions as F

    from tessel.functions.grid import diagonal_major, executor_grid

    keys = block_keys(spark, Grid(4, 4))
    number = {(r.bi, r.bj): (r.m, r.c) for r in keys.select("bi", "bj", diagonal_major(3, F.col("bi"), F.col("bj")).alias("m"), executor_grid(4, 4, F.col("bi"), F.col("bj")).alias("c")).collect()}
    assert [number[k][0] for k in [(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (0, 2)]] == [0, 1, 2, 3, 3, 4, 5]
    assert number[3, 1][1] == 2
    assert place(keys, "md", 100, Grid(4, 4)).withColumn("p", F.spark_partition_id()).where("bi = 0 and bj = 1").first().p == 4
    with pytest.raises(ValueError):
        place(keys, "round", 3, Grid(4, 4))
    for bad in ({"strategy": "x"}, {"kernel": "x"}, {"placement": "x"}, {"persist": "x"}, {"grid": -1}):
        with pytest.raises(ValueError):
            SolveOptions(**bad)


def test_generated_values_do_not_depend_on_partitions(spark):
    one = inputs.random_cells(spark, 9, "graph").collect()
    assert sorted(one) == sorted(inputs.random_cells(spark, 9, "graph").repartition(5).collect())
    assert all(1 <= r.v <= 10 and r.i != r.j for r in one)
    with pytest.raises(ValueError):
        inputs.random_cells(spark, 3, "x")


def test_command_line_and_sinks(spark, tmp_path):
    solve.main(["--problem", "fw", "--n", "6", "--grid", "2", "--output", f"{tmp_path}/fw"])
    assert duckdb.sql(f"SELECT count(*) FROM '{tmp_path}/fw/*.parquet'").fetchall() == [(36,)]
    solve.main(["--problem", "ge", "--n", "5", "--strategy", "shuffle", "--kernel", "tiled", "--base-size", "2"])
    solve.main(["--problem", "paf", "--n", "9", "--strategy", "cells"])
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "src int, dst int, w double")
    inputs.write(edges, f"{tmp_path}/edges")
    assert inputs.edges_from(spark, f"{tmp_path}/edges").count() == 2
    inputs.write(edges, f"{tmp_path}/text", "text")
    assert spark.read.json(f"{tmp_path}/text").count() == 2
    seq = spark.createDataFrame([(1, "a"), (2, "b")], "pos int, ch string")
    inputs.write(seq, f"{tmp_path}/seq")
    solve.main(["--problem", "gap", "--input", f"{tmp_path}/seq", "--second", f"{tmp_path}/seq"])
    with pytest.raises(SystemExit):
        solve.main(["--problem", "fw"])


def test_a_stream_of_edges(spark, tmp_path):
    for k, rows in enumerate([[(0, 1, 9.0), (1, 2, 4.0)], [(0, 1, 2.0)], [(2, 0, 1.0)]]):
        spark.createDataFrame(rows, "src int, dst int, w double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("src int, dst int, w double").parquet(f"{tmp_path}/in")
        query = paths_of_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", 3, SolveOptions(grid=2))
        assert query.awaitTermination(120)
        assert query.exception() is None
        assert spark.read.parquet(f"{tmp_path}/out/{k}").count() > 0
    got = {(r.i, r.j): r.v for r in spark.read.parquet(f"{tmp_path}/out/2").collect()}
    assert (got[0, 2], got[2, 1], got[1, 0], len(got)) == (6, 3, 5, 9)


def test_squaring_doubles_of_unlike_sizes(spark):
    """A sum over all cells would hide small changes beside the large weights."""
    chain = [(k, k + 1, 0.5) for k in range(7)]
    edges = spark.createDataFrame([*chain, (2, 5, 9.0), (0, 8, 1e17), (8, 0, 1e17)], "src int, dst int, w double")
    got = {(r.i, r.j): r.v for r in solve.shortest_paths(edges, 9, SolveOptions(strategy="cells")).collect()}
    assert got == {(r.i, r.j): r.v for r in solve.shortest_paths(edges, 9, SolveOptions(grid=3)).collect()}
    assert got[2, 5] == 1.5


def test_generated_sequences_and_printed_rows(spark, tmp_path, capsys):
    from tessel.plans.solve import main
    from tessel.sources.inputs import matrix_rows, random_sequence

    assert [r.ch for r in random_sequence(spark, 9, 30).orderBy("pos").collect()] == [r.ch for r in random_sequence(spark, 9, 30).repartition(5).orderBy("pos").collect()]
    assert {r.ch for r in random_sequence(spark, 200, 5).collect()} == set("ABCD")
    cells = spark.createDataFrame([(0, 0, 1), (0, 2, 3), (2, 1, 5)], "i int, j int, v int")
    assert {(r.i, r.line) for r in matrix_rows(cells).collect()} == {(0, "1 - 3"), (2, "- 5 -")}
    main(["--problem", "gap", "--n", "5", "--output", f"{tmp_path}/gap", "--print"])
    assert spark.read.parquet(f"{tmp_path}/gap").count() == 36
    assert len(capsys.readouterr().out.strip().splitlines()) == 6


def test_tables_need_a_shared_folder_on_a_cluster():
    from tessel.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
