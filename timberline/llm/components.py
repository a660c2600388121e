"""Connected components of links, as rounds of joins between written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import forget, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task, reduced to links of each node to the least node it reaches within the task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.array([n for n in root if find(n) != n], np.int64)
    tops = np.array([find(n) for n in nodes.tolist()], np.int64)
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(tops[k : k + 100_000])], ["a", "b"])


def apart(df: DataFrame, key: str) -> DataFrame:
    """df, no longer dealt out by `key` in the plan's eyes: a join by it shuffles both sides anew and so can split a hot key."""
    return df.withColumn(key, F.shiftright(key, 0))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long); component: the least node reachable.

    Each round shortens paths within tasks, then points all neighbours of a
    node to its least neighbour (large star, then small star), until nothing
    changes.  Least neighbours come from map-side aggregation and are joined
    back by plain shuffles, so that the links of a hub can be split.  A round's
    table is deleted when the next is written.
    """
    edges, seen, before = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b"), None, None
    while True:
        edges = edges.mapInArrow(_forest, "a long, b long")
        # large star: larger neighbours of each node move to its least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = apart(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m")), "n")
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: what is not larger than a node, and the node itself, move to the least of them
        low = apart(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "n")
        small = large.join(low, large["a"] == low["n"]).select("a", "b", "m")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(small.select("a", F.col("m").alias("b"))).distinct()
        edges = written(moved)
        count = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = (count[0], str(count[1]))
        if before is not None:
            forget(before)
        if now == seen:
            break
        seen, before = now, edges
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
