"""Connected components of a large graph by alternating stars.

Rounds of large-star and small-star operations turn every component into a star around
its smallest node. Every round is two aggregations and two joins, checkpointed in the
shared folder; the number of rounds grows with the logarithm of the longest path.
Minima are aggregated before the shuffle, so a node with very many neighbours does not
gather them in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vintry.llm.columns import checkpointed, map_batches

# Links that a task holds before it reduces them to stars.
HELD = 1 << 17


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) that connect just what the links connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # Roots of linked nodes hang below the smaller one; then every node finds its root.
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def spanning(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links that connect what ``links`` (two bigint columns) connect, a forest per block.

    A task reduces its links ``HELD`` at a time, so a group in which all link to all leaves
    a task as one link per member, not as all its pairs, and nothing is shuffled for it.
    """

    def reduced(batches):
        a = b = np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(a) >= HELD:
                a, b = stars(a, b)
                if len(a) >= HELD // 2:  # a forest by itself: more links would not shrink it
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.empty(0, np.int64)
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    return map_batches(links.where(both).select(left, right), reduced, "a bigint, b bigint")


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours, for edges kept both ways."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """``edges`` holds (u, v) with u > v, once each."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both), "u").where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    # An edge to a larger neighbour exists from both ends, so each is moved to some minimum.
    large = large.where("u != v").distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, checkpointed, and a digest of them that the same job counts on its way."""
    seen = Observation()
    digest = [
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"),
        F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("b"),
    ]
    kept = checkpointed(edges.observe(seen, *digest))
    found = seen.get
    return kept, (found["n"] or 0, found["a"], found["b"])


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    Links may come in any order and direction, repeated, or from a node to itself; those
    with a null end are left out.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    edges, state = _counted(edges)
    while state[0]:
        before = state
        edges, state = _counted(_round(edges))
        if state == before:
            break
    rays = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return rays.unionByName(centres)
