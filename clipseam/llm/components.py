"""Connected components over an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked pairs of ids: each id, and the smallest id of its component among these pairs."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). A row (node, component) for each node that has an edge to another; component is the smallest node reachable.

    Each round points every node at the smallest of its neighbourhood, first its larger neighbours, then its smaller
    ones; rounds end when all components are stars, after about the logarithm of the longest path. A hub's edges are aggregated
    before they are shuffled, and its join can be split by the engine.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(edges):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, F.col("u") == F.col("_u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        parent = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "_b")
        small = large.join(parent, F.col("b") == F.col("_b")).select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        edges = cut(small, "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether each b has one a, and no a is a b: then a is the smallest of its component."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 OR c = 1 AND p = 1").isEmpty()
