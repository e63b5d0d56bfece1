"""Components and representatives of large undirected graphs, as rounds of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut_afresh, cut_lineage


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(
        edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()


def salted(large: DataFrame, small: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Left join of rows whose key may be hot with a side that has each key once, which is copied per salt."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node that has an edge; the component is its least node id.

    In a round every node hooks onto its least neighbour, if that is less than itself; chains of hooks are halved until
    all point to roots, and the graph is contracted to edges between different roots. Each round at least halves the nodes
    that still have edges, so there are O(log n) rounds of O(log n) hops, on tables that shrink; a finished component
    has no edges left and takes no further part. Joins that look up a shared root are salted. The edges are read twice, so they
    are written out first: what made them runs once.
    """
    ends = cut_afresh(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    nodes = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct()
    open_ = cut_afresh(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = nodes.withColumn("component", F.col("id"))
    while not open_.isEmpty():
        near = both_ways(open_).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
        hooks = cut_afresh(near.select("id", F.least("id", "near").alias("root")))
        while True:
            further = hooks.filter("id <> root").select(F.col("id").alias("root"), F.col("root").alias("next"))
            hops = cut_afresh(salted(hooks, further, "root", "id"))
            hooks = hops.select("id", F.coalesce("next", "root").alias("root"))
            if hops.filter("next IS NOT NULL").isEmpty():
                break
        moved = hooks.filter("id <> root")
        label = salted(label, moved.withColumnRenamed("id", "component"), "component", "id").select("id", F.coalesce("root", "component").alias("component"))
        for end in ("a", "b"):
            open_ = salted(open_, moved.withColumnRenamed("id", end), end, "b" if end == "a" else "a").withColumn(end, F.coalesce("root", end)).drop("root")
        open_ = cut_afresh(open_.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return cut_afresh(label)


def kept(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``(id, rank)``: greedy cover by falling (weight, id); a node is kept when no heavier neighbour is.

    Edges lead from the lighter to the heavier end. A round keeps every undecided node without an edge, drops what has an edge to it, and
    keeps the edges between undecided nodes only; with a unique order this gives the sequential greedy answer. ``nodes(id, weight)``.
    """
    open_ = cut_afresh(nodes.select("id", F.struct(F.col(weight).alias("w"), F.col("id").alias("i")).alias("rank")))
    rank = lambda end: open_.select(F.col("id").alias(end), F.col("rank").alias(f"r{end}"))
    links = edges.filter("a <> b").join(rank("a"), "a").join(rank("b"), "b").select(
        F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    links = cut_afresh(links)
    found = None
    while True:
        won = cut_afresh(open_.join(links.select(F.col("src").alias("id")), "id", "left_anti"))
        found = won if found is None else found.unionByName(won)
        beaten = links.join(won.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        open_ = cut_afresh(open_.join(won, "id", "left_anti").join(beaten, "id", "left_anti"))
        if open_.isEmpty():
            return cut_afresh(found)
        left = open_.select("id")
        links = cut_afresh(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def representatives(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``(id, representative)``: the nodes of ``kept`` with themselves, others with their heaviest kept neighbour."""
    edges = cut_afresh(edges.select("a", "b"))
    chosen = kept(nodes, edges, weight)
    best = both_ways(edges).join(chosen.select(F.col("id").alias("dst"), "rank"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("rank").alias("rank"))
    members = best.join(chosen, "id", "left_anti").select("id", F.col("rank.i").alias("representative"))
    return chosen.select("id", F.col("id").alias("representative")).unionByName(members)
