"""Medoid clustering of a similarity graph, and headings of repeated routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.durable import durable, salted_join
from millrace.operators.sets import set_classes, similar_classes


def medoid_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 200, weight: str | None = None) -> DataFrame:
    """(id, seed): greedy clusters. The free node with most free neighbours, ties to the least id, seeds a cluster and takes those neighbours; and so on.

    weight: a column of nodes, how many nodes each one stands for that are linked with one another and with the same others; they are taken
    together in any order, so the least of them can stand for all. Nodes without links are settled at the start. Each round takes at once every node that beats all free nodes up to two links away. Degrees
    only fall, so the one-by-one order would take the same ones; the result is the same.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    given = nodes.select("id", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).distinct()
    links = durable(both)
    linked = links.select(F.col("a").alias("id")).distinct()
    done = given.join(linked, "id", "left_anti").select("id", F.col("id").alias("seed"))
    free = durable(given.join(linked, "id", "left_semi"))
    if free.isEmpty():
        return done
    for _ in range(rounds):
        near_by = links.join(free.select(F.col("id").alias("b"), "w"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("count"))
        rank = free.join(near_by, "id", "left").select("id", F.struct((F.coalesce("count", F.lit(0)) + F.col("w") - 1).alias("n"), (-F.col("id")).alias("i")).alias("r"))
        one = links.join(rank, links.b == rank.id).groupBy(F.col("a").alias("id")).agg(F.max("r").alias("m"))
        near = rank.join(one, "id", "left").select("id", "r", F.greatest("r", F.coalesce("m", "r")).alias("m"))
        two = links.join(near.select(F.col("id").alias("b"), "m"), "b").groupBy(F.col("a").alias("id")).agg(F.max("m").alias("m2"))
        seeds = near.join(two, "id", "left").where(F.col("r") == F.greatest("m", F.coalesce("m2", "m"))).select(F.col("id").alias("seed"))
        taken = seeds.select(F.col("seed").alias("id"), "seed").unionByName(links.join(seeds, links.a == seeds.seed).select(F.col("b").alias("id"), "seed"))
        taken = durable(taken)
        done = done.unionByName(taken)
        free = durable(free.join(taken.select("id"), "id", "left_anti"))
        if free.isEmpty():
            return done
        gone = taken.select(F.col("id").alias("x"))
        links = durable(links.join(gone, links.a == gone.x, "left_anti").join(gone, links.b == gone.x, "left_anti"))
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def clustered_sets(nodes: DataFrame, members: DataFrame, owner: str, element: str, threshold: float) -> DataFrame:
    """(id, seed): medoid clusters of nodes (id) whose element sets overlap by at least the threshold; a node without elements is one by itself.

    Owners of equal sets go as one weighted node, so copies make no pairs.
    """
    known = members.join(nodes.select(F.col("id").alias(owner)), owner, "left_semi")
    classes = set_classes(known, owner, element)
    edges = durable(similar_classes(classes, threshold))
    found = medoid_clusters(classes.sets.select(F.col("rep").alias("id"), "copies"), edges.select(F.col("x").alias("a"), F.col("y").alias("b")), weight="copies")
    placed = salted_join(classes.owners, found.select(F.col("id").alias("rep"), "seed"), ["rep"]).select("id", "seed")
    return nodes.join(placed, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def heading(laps: Column, area: Column, circularity: Column, sure: float = 0.5, round_from: float = 0.02) -> Column:
    """cw or ccw on a route that encloses something, else forward or reverse; unknown under `sure` laps."""
    forward = laps > 0
    return F.when(F.abs(laps) < sure, "unknown").when(circularity >= round_from, F.when(forward == (area > 0), "ccw").otherwise("cw")).otherwise(F.when(forward, "forward").otherwise("reverse"))
