"""Shortest, weighted and simple paths by frontier joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.shared import cut


def links(edges: DataFrame, directed: bool = False, weight: str | None = None) -> DataFrame:
    """(u, v, w) of edges (src, dst): both ways unless directed; a missing or non-numeric weight is 1."""
    w = F.coalesce(F.col(weight).try_cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    return out if directed else out.unionByName(out.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """(source, node, hops) of all nodes reached from sources (source): one frontier per level.

    A level joins the frontier with the edges and drops pairs seen before by an anti join.
    """
    hop = links(edges, directed).select("u", "v").distinct()
    seen = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier, level = seen, 0
    while most is None or level < most:
        level += 1
        near = frontier.join(hop, frontier.node == hop.u).select("source", F.col("v").alias("node")).distinct()
        frontier = cut(near.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None, directed: bool = False, via: DataFrame | None = None) -> DataFrame:
    """(source, target, hops, path) for pairs (source, target); pairs without a path, and equal ends, are left out.

    Each level keeps one path per source and node, the least by its nodes. via (node) names the nodes that may lie between.
    """
    hop = links(edges, directed).select("u", "v").distinct()
    wanted = pairs.select("source", "target").where("source <> target").distinct()
    found = cut(wanted.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    frontier, level, reached = found, 0, None
    seen = found.select("source", "node")
    while most is None or level < most:
        level += 1
        near = frontier.join(hop, frontier.node == hop.u).select("source", F.col("v").alias("node"), F.array_append("path", F.col("v")).alias("path"))
        near = near.join(seen, ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        near = cut(near)
        if near.isEmpty():
            break
        seen = seen.unionByName(near.select("source", "node"))
        hits = near.withColumnRenamed("node", "target").join(wanted, ["source", "target"]).select("source", "target", F.lit(level).alias("hops"), "path")
        reached = hits if reached is None else reached.unionByName(hits)
        wanted = cut(wanted.join(near.select("source", F.col("node").alias("target")), ["source", "target"], "left_anti"))
        frontier = near.join(wanted.select("source").distinct(), "source", "left_semi")
        if via is not None:
            frontier = frontier.join(via, "node", "left_semi")
    if reached is None:
        reached = wanted.limit(0).select("source", "target", F.lit(0).alias("hops"), F.array("source").alias("path"))
    return reached


def cheapest(edges: DataFrame, sources: DataFrame, weight: str, directed: bool = False) -> DataFrame:
    """(source, node, cost): least total weights, by relaxation until nothing changes. Negative weights are an error."""
    hop = cut(links(edges, directed, weight).groupBy("u", "v").agg(F.min("w").alias("w")))
    if not hop.where("w < 0").isEmpty():
        raise ValueError("negative weights")
    best = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")).distinct())
    frontier = best
    while not frontier.isEmpty():
        near = frontier.join(hop, frontier.node == hop.u).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        both = cut(best.join(near, ["source", "node"], "full_outer"))
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        frontier = both.where(better).select("source", "node", F.col("new").alias("cost"))
        best = both.select("source", "node", F.least("cost", "new").alias("cost"))
    return best


def all_paths(edges: DataFrame, source, target, max_hops: int = 5, directed: bool = True, max_results: int | None = None) -> DataFrame:
    """(path, hops): simple paths, which repeat no node."""
    hop = links(edges, directed).select("u", "v").distinct()
    level = hop.where(F.col("u") == source).where("u <> v").select(F.array("u", "v").alias("path"))
    out = None
    for n in range(1, max_hops + 1):
        done = level.where(F.element_at("path", -1) == target).select("path", F.lit(n).alias("hops"))
        out = done if out is None else out.unionByName(done)
        if n < max_hops:
            level = level.where(F.element_at("path", -1) != target).join(hop, F.element_at("path", -1) == hop.u).where(~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path"))
    return out if max_results is None else out.orderBy("hops", "path").limit(max_results)


def connected(edges: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """pairs (source, target) with whether both lie in one component (node, component)."""
    a = components.select(F.col("node").alias("source"), F.col("component").alias("_a"))
    b = components.select(F.col("node").alias("target"), F.col("component").alias("_b"))
    return pairs.join(a, "source", "left").join(b, "target", "left").withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def expand(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id): nodes within some hops of start (id) in any direction, the start included."""
    hop = links(edges).select("u", "v").distinct()
    seen = start.select("id").distinct()
    for _ in range(hops):
        seen = seen.join(hop, seen.id == hop.u).select(F.col("v").alias("id")).union(seen).distinct()
    return seen


def path_columns(names: Sequence[str]) -> tuple:
    """nodes, length of a path given by bound variables in order."""
    return F.array(*[F.col(f"{n}.id").cast("string") for n in names]), F.lit(len(names) - 1)
