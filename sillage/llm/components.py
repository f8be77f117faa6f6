"""Connected components of a link table, by union-find on partitions and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.arrow import tidy
from sillage.llm.scratch import Scratch


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its component, for every node that is not the smallest itself."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


#: Links that one union-find holds at a time; more are merged between partitions.
LINKS_IN_MEMORY = 1_000_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        found = union_find(iter(held))
        held.clear()
        return pa.RecordBatch.from_pydict({"hi": pa.array(found.keys(), pa.int64()), "lo": pa.array(found.values(), pa.int64())})

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= LINKS_IN_MEMORY:
            yield flush()
    yield flush()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node but the smallest of each component.

    ``links`` has two long columns without nulls.  Union-find first turns each
    partition's links into stars.  Then, in rounds, every node hooks onto its smallest
    neighbour, the resulting forest is flattened by pointer doubling, and the links are
    rewritten to the roots; the roots at least halve each round.  Only aggregates with
    map-side combine and joins that Spark can split are used, so a component with a
    large part of all nodes is no single task's work.
    """
    edges = scratch.save(links.mapInArrow(tidy(_forests), "hi long, lo long").distinct())
    labels = None
    while not edges.isEmpty():
        forest = scratch.save(edges.groupBy("hi").agg(F.min("lo").alias("lo")))
        while True:
            up = forest.select(F.col("hi").alias("lo"), F.col("lo").alias("top"))
            step = scratch.save(forest.join(up, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"), F.col("top").isNotNull().alias("moved")))
            forest = step.select("hi", "lo")
            if step.filter("moved").isEmpty():
                break
        low = forest.select(F.col("hi").alias("lo"), F.col("lo").alias("b"))
        between = edges.join(forest.select("hi", F.col("lo").alias("a")), "hi").join(low, "lo", "left")
        between = between.select("a", F.coalesce("b", "lo").alias("b")).filter("a <> b")
        edges = scratch.save(between.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
        forest = forest.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        if labels is None:
            labels = forest
        else:
            moved = forest.select(F.col("node").alias("component"), F.col("component").alias("top"))
            older = labels.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            labels = scratch.save(older.unionByName(forest))
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels
