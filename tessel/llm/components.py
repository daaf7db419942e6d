"""Connected components of a table of links, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links a task holds: one link from each node to the least node it meets here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.record_batch([pa.array(nodes, type=pa.int64()), pa.array([root(x) for x in nodes], type=pa.int64())], names=["node", "label"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label for every node that isn't the least of its component; label is the least.

    links: two columns of ids. In each round a node's links are all moved to its least neighbour
    (large star, then small star), until nothing changes. Both stars aggregate before they shuffle.
    """
    a, b = links.columns
    edges = scratch.save(links.where(F.col(a) != F.col(b)).select(a, b).mapInArrow(_local, "node long, label long"), f"{name}-0")
    number, last = 0, None
    while True:
        number += 1
        both = edges.unionByName(edges.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.min("label").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where(F.col("label") > F.col("node")).join(least, "node").select(F.col("label").alias("node"), F.col("least").alias("label"))
        large = large.where(F.col("node") != F.col("label")).distinct()
        # every link now points down; each node's labels are linked with the least of them
        low = large.groupBy("node").agg(F.min("label").alias("least"))
        small = large.join(low, "node").where(F.col("label") != F.col("least")).select(F.col("label").alias("node"), F.col("least").alias("label"))
        found = small.unionByName(low.select("node", F.col("least").alias("label"))).distinct()
        edges = scratch.save(found, f"{name}-{number}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")), F.countDistinct("node")).first()
        if number > 1:
            scratch.drop(f"{name}-{number - 1}")
        if state == last and state[0] == state[2]:
            return edges
        last = state
