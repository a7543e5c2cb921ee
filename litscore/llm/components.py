"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import store

_ROUNDS = 60


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of 0..n-1, by whole-array steps."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _minimum_of_neighbours(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least.hint("merge"), "u")


def _contract(edges: DataFrame) -> DataFrame:
    """Edges of the same components: those that lie in one partition become stars to their least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches if b.num_rows]
        if not held:
            return
        pairs = np.concatenate(held, axis=1)
        nodes, which = np.unique(pairs, return_inverse=True)
        a, b = which.reshape(pairs.shape)
        root = forest_of(len(nodes), a, b)
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def _not_stars(edges: DataFrame) -> int:
    """Nodes that have two smaller neighbours, or a smaller and a larger one."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("r"))
    sums = roles.select("r.*").groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 OR up = 1 AND down = 1").count()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node reachable.

    Edges that meet in a partition are contracted there; then large and small stars are
    formed in turn until only stars are left. One number a round passes through the driver,
    and each round is stored. A node with very many neighbours is split by the skew handling
    of the join.
    """
    first = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = store(_contract(first).distinct(), name)
    for _ in range(_ROUNDS):
        if not _not_stars(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum_of_neighbours(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _minimum_of_neighbours(large.filter("u <> v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = store(_contract(small.filter("u <> v")).distinct(), name)
    else:
        raise RuntimeError(f"components are not found after {_ROUNDS} rounds")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
