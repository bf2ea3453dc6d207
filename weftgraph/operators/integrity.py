"""Integrity rules: each returns the nodes or relationships that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph


def _ends(g: PropertyGraph, node_type: str, edge: str | None, direction: str) -> DataFrame:
    """ids of a type's nodes at the ends of relationships."""
    out = None
    for _, t in g.edge_pairs(edge):
        for end, kind, way in (("src", t.src_type, "out"), ("dst", t.dst_type, "in")):
            if kind == node_type and direction in (way, "both"):
                df = t.df.select(F.col(end).alias("id"))
                out = df if out is None else out.union(df)
    return out if out is not None else g.nodes[node_type].select("id").limit(0)


def orphan_nodes(g: PropertyGraph, node_type: str, edge: str | None = None, direction: str = "both") -> DataFrame:
    return g.nodes[node_type].join(_ends(g, node_type, edge, direction), "id", "left_anti")


def self_loops(g: PropertyGraph, node_type: str, edge: str) -> DataFrame:
    loops = g.edge_table(edge, node_type, node_type).where("src = dst").select(F.col("src").alias("id")).distinct()
    return g.nodes[node_type].join(loops, "id", "left_semi")


def cycles_of_two(g: PropertyGraph, node_type: str, edge: str) -> DataFrame:
    """(a, b), a < b, linked both ways."""
    e = g.edge_table(edge, node_type, node_type).select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def missing_required_edge(g: PropertyGraph, node_type: str, edge: str) -> DataFrame:
    return orphan_nodes(g, node_type, edge, "out")


def missing_inbound_edge(g: PropertyGraph, node_type: str, edge: str) -> DataFrame:
    return orphan_nodes(g, node_type, edge, "in")


def duplicate_titles(g: PropertyGraph, node_type: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("title"))
    return g.nodes[node_type].where("title is not null").withColumn("_n", n).where("_n > 1").drop("_n")


def inverse_violations(g: PropertyGraph, edge_a: str, edge_b: str) -> DataFrame:
    """(src, dst) of edge_a without edge_b from dst to src."""
    a = g.edge_table(edge_a).select("src_type", "src", "dst_type", "dst").distinct()
    b = g.edge_table(edge_b).select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
    return a.join(b, ["src_type", "src", "dst_type", "dst"], "left_anti").select("src", "dst")


def transitivity_violations(g: PropertyGraph, edge: str) -> DataFrame:
    """(a, b, c) with a -> b -> c but not a -> c."""
    e = g.edge_table(edge).select("src", "dst").distinct()
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c and a <> b and b <> c")
    return two.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti").select("a", "b", "c")


def cardinality_violations(g: PropertyGraph, node_type: str, edge: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Nodes with their number of outgoing relationships, where it is outside the limits."""
    n = _ends(g, node_type, edge, "out").groupBy("id").agg(F.count("*").alias("edge_count"))
    out = g.nodes[node_type].join(n, "id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col("edge_count") < least)
    if most is not None:
        bad = bad | (F.col("edge_count") > most)
    return out.where(bad)


def type_domain_violations(g: PropertyGraph, edge: str, expected_source: str) -> DataFrame:
    return g.edge_table(edge).where(F.col("src_type") != expected_source).select("src_type", "src", "dst_type", "dst")


def type_range_violations(g: PropertyGraph, edge: str, expected_target: str) -> DataFrame:
    return g.edge_table(edge).where(F.col("dst_type") != expected_target).select("src_type", "src", "dst_type", "dst")


def parallel_edges(g: PropertyGraph, edge: str) -> DataFrame:
    return g.edge_table(edge).groupBy("src_type", "src", "dst_type", "dst").agg(F.count("*").alias("edge_count")).where("edge_count > 1")


def null_property(g: PropertyGraph, node_type: str, name: str) -> DataFrame:
    df = g.nodes[node_type]
    return df.where(F.col(name).isNull()) if name in df.columns else df


RULES = {f.__name__: f for f in (orphan_nodes, self_loops, cycles_of_two, missing_required_edge, missing_inbound_edge, duplicate_titles, inverse_violations, transitivity_violations, cardinality_violations, type_domain_violations, type_range_violations, parallel_edges, null_property)}


def validate(g: PropertyGraph) -> DataFrame | None:
    """(type, rule, field, violations) against the declared schema; None without one.

    A schema is {type: {"required": [...], "types": {field: spark type}}}.
    """
    if not g.schema:
        return None
    out = None
    for kind, spec in g.schema.items():
        if kind not in g.nodes:
            continue
        df = g.nodes[kind]
        checks = [("required", f, F.col(f).isNull() if f in df.columns else F.lit(True)) for f in spec.get("required", ())]
        checks += [("type", f, F.col(f).isNotNull() & F.lit(dict(df.dtypes)[f] != t)) for f, t in spec.get("types", {}).items() if f in df.columns]
        if not checks:
            continue
        sums = df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
        rows = sums.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(r).alias("rule"), F.lit(f).alias("field"), F.coalesce(f"c{i}", F.lit(0)).alias("violations")) for i, (r, f, _) in enumerate(checks)])).alias("v")).select("v.*").where("violations > 0")
        out = rows if out is None else out.unionByName(rows)
    return out
