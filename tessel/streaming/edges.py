"""Shortest paths kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.plans.options import SolveOptions
from tessel.plans.solve import DEFAULT, shortest_paths
from tessel.sources.scratch import Scratch


def paths_of_stream(edges: DataFrame, output: str, checkpoint: str, n: int | None = None, options: SolveOptions = DEFAULT, **trigger) -> StreamingQuery:
    """Starts a query that writes i, j, v to `output`/<batch> for every batch of a stream of src, dst, w.

    New edges can only shorten paths, so a batch is solved over the distances so far and its own
    edges; earlier edges are not read again. A batch that is run again overwrites its own folder.
    """
    spark = edges.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        known = batch.select("src", "dst", F.col("w").cast("double").alias("w"))
        if number:
            last = spark.read.parquet(f"{output}/{number - 1}").where("i <> j")
            known = known.unionByName(last.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")))
        kept = Scratch(spark, "stream").save(known, "edges")
        shortest_paths(kept, n, options).write.mode("overwrite").parquet(f"{output}/{number}")

    return edges.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
