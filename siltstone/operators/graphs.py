"""Graph algorithms on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import session


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component of edges (a, b), by alternating large and small stars.

    Rounds go on until the edges no longer change; their number grows with the logarithm of a component's diameter. Each
    round replaces edges by edges to smaller ids; every round's edges are written to the shared folder, so lineage
    stays short. No component is ever gathered in one task.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = session.cut(edges.select("a", "b").where("a <> b").distinct())
    while True:
        # Large star: each node's larger neighbours are joined to its smallest neighbour (or itself).
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node's smaller neighbours and itself are joined to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select("b", "m").unionByName(floor.select(F.col("a").alias("b"), "m")).where("b <> m")
        new = session.cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, leader): G1. Nodes (id) in the order of their ids: a node joins the smallest leader that an edge (a, b) of nodes joins
    it to, else leads itself; no chains. The leaders are the lexicographically first maximal independent set of the edges.

    In each round an undecided node without a smaller undecided neighbour becomes a leader and its undecided neighbours
    become members, whose edges are dropped. A round moves what is left of the edges alone: nodes without edges take no
    part, and all nodes that became no member lead.
    """
    both = session.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    left, members = both, None
    while not left.isEmpty():
        fresh = left.groupBy("a").agg(F.min("b").alias("m")).where("a < m").select(F.col("a").alias("b"))
        found = session.cut(left.join(fresh, "b", "left_semi").select(F.col("a").alias("id")).distinct())
        members = found if members is None else members.unionByName(found)
        left = session.cut(left.join(found.withColumnRenamed("id", "a"), "a", "left_anti").join(found.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    ids = nodes.select("id").distinct()
    if members is None:
        return ids.select("id", F.col("id").alias("leader"))
    joined = both.join(members.withColumnRenamed("id", "b"), "b", "left_anti").join(members.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("a").agg(F.min("b").alias("leader"))
    return ids.join(joined.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
