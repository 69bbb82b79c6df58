"""Connected components of an undirected edge table, by alternating star contraction.

Each round first contracts the edges of each partition to a spanning forest, then attaches every
node to the least neighbour it knows of, first among its larger neighbours and then among its
smaller ones. The edge table shrinks to one edge per node and never leaves the executors; each
round ends in a checkpoint, so a lost executor costs one round at most. Rounds needed grow with
the logarithm of the longest chain. Partitions are sized to `share` edges: edges that fit into
one are settled by its forest alone, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    inner = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n indices over the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)  # a root hooks on with all that it stands for
        np.minimum.at(new, label[j], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches) over the edges (a, b), roots themselves left out."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = roots(len(nodes), at[: len(a)], at[len(a) :])
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _contracted(edges: DataFrame, share: int) -> DataFrame:
    """Each partition's edges as stars; of more than 4 * share edges at a time, those so far go first into stars of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        for batch in batches:
            a, b = np.r_[a, batch.column(0).to_numpy()], np.r_[b, batch.column(1).to_numpy()]
            if len(a) > 4 * share:
                a, b = _forest(a, b)
                if len(a) > 2 * share:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.empty(0, np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([*map(pa.array, _forest(a, b))], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60, share: int = 250_000) -> DataFrame:
    """(a, b) edges -> (node, root): each node that has an edge, with the least node it reaches.

    Self-loops and repeated edges are allowed; an empty table gives an empty result. share: about how
    many edges a partition holds at each round.
    """
    state = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
        parts = max(1, -(-now[0] // share))
        state = _contracted(state.coalesce(parts), share)
        if parts == 1:
            state = durable(state)
            break
        state = durable(_small_star(_large_star(state)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()
