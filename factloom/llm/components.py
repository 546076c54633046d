"""Connected components of a graph given by its edges: union-find in each partition, then alternating star contraction."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import checkpointed

#: Edges that one partition holds on average; a partition keeps less than one edge for each of its nodes.
PART_EDGES = 200_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of these edges, sorted, and the least node of each one's component among them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hang on lesser roots only
        while (root[root] != root).any():
            root = root[root]


def _stars(batches):
    """The edges of a partition as stars around the least node of each of its components."""
    u, v = [], []
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if u:
        nodes, root = least_reachable(np.concatenate(u), np.concatenate(v))
        keep = nodes != root
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[keep], pa.int64()), "v": pa.array(root[keep], pa.int64())})


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges as stars of each partition, and the number of partitions."""
    held = checkpointed(edges)
    parts = max(1, -(-held.count() // PART_EDGES))
    return checkpointed(held.coalesce(parts).mapInArrow(_stars, "u long, v long")), parts


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: u, v (long). Result: node, root, where root is the least node of node's component.

    Edges stand in partitions of about PART_EDGES; each is contracted to stars by itself, which is the answer when one
    partition is left. Otherwise a round hangs a node's larger neighbours on its least one (large star), then its smaller
    ones (small star), which brings the stars of different partitions together. All steps keep the graph connected and
    its number of edges no larger; a star forest is the fixed point. Rounds grow with the logarithm of the number
    of nodes. Nulls and loops are dropped; an edge may come more than once.
    """
    now, parts = _contracted(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    state = None
    for _ in range(most):
        if parts == 1:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        #: A node that is its neighbours' least keeps them, as m is then the node itself.
        large = large.filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = checkpointed(small.filter("u <> v").distinct())
        one = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(one) == state:
            now = stars
            break
        state = tuple(one)
        now, parts = _contracted(stars)
    else:
        raise RuntimeError(f"components: no fixed point in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
