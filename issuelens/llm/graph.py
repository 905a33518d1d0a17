"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task folds at once.
HELD = 1 << 20


def _told(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows with the m of their u. A sort-merge join of two tables at every size: the rows of a hub make a large partition, which Spark splits as long as neither side comes from an aggregate by u; so least is written."""
    return rows.join(written(least).hint("merge"), "u")


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _told(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _told(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for each node of edges a-b; both long. Each round is written out, so that the plan stays short."""
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = written(_small(_large(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of edges a-b to the least that they lead to: at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), np.split(at, 2)
    while True:
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        if not len(x):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(np.flatnonzero(root[root] != root)):
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fold(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*held)))

    held, n = [], 0
    for batch in batches:
        some = batch.filter(pc.is_valid(pc.add(batch.column("a"), batch.column("b"))))
        held.append((some.column("a").to_numpy(), some.column("b").to_numpy()))
        n += some.num_rows
        if n > HELD:
            held = [fold(held)]
            n = len(held[0][0])
            if n > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold(held)], ["a", "b"])


def folded(edges: DataFrame) -> DataFrame:
    """Edges a-b that connect what edges (a, b: long) connect: those of a task as stars around their least nodes, so that few are shuffled and chains inside a task need no rounds."""
    return edges.select("a", "b").mapInArrow(_folded, "a long, b long")
