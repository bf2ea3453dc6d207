"""Changes: each returns a new graph; the old one stays as it was, so a transaction is a choice between two."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.catalog import EdgeTable, PropertyGraph
from weftgraph.operators.shared import cut


def create_nodes(g: PropertyGraph, node_type: str, rows: DataFrame, title: str | None = None) -> PropertyGraph:
    """Append nodes; their ids follow the largest of the type, in order of all columns."""
    old = g.nodes.get(node_type)
    first = 0 if old is None else (old.agg(F.max(F.col("id").cast("long"))).first()[0] or 0) + 1
    rows = rows.drop("id")
    # numbers in two levels: rows before a partition, and a row's place in it
    spread = cut(rows.repartitionByRange(*rows.columns).withColumn("_p", F.spark_partition_id()))
    before = spread.groupBy("_p").agg(F.count("*").alias("_k")).select("_p", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*rows.columns)) - 1
    numbered = spread.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("_n", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")
    name = F.col(title).cast("string") if title else F.concat(F.lit(f"{node_type}_"), (F.col("_n") + first).cast("string"))
    new = numbered.select((F.col("_n") + first).cast(dict(old.dtypes)["id"] if old is not None else "bigint").alias("id"), name.alias("title"), *[c for c in rows.columns if c not in (title, "title")])
    table = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return g._next("create_nodes", {"nodes_created": new.count()}, nodes={**g.nodes, node_type: table})


def create_edges(g: PropertyGraph, edge_type: str, src_type: str, dst_type: str, rows: DataFrame) -> PropertyGraph:
    """Append relationships (src, dst and properties), parallel ones included."""
    tables = list(g.edges.get(edge_type, ()))
    for i, t in enumerate(tables):
        if (t.src_type, t.dst_type) == (src_type, dst_type):
            tables[i] = replace(t, df=t.df.unionByName(rows, allowMissingColumns=True), key=None)
            break
    else:
        tables.append(EdgeTable(src_type, dst_type, rows))
    return g._next("create_edges", edges={**g.edges, edge_type: tuple(tables)})


def _forget_keys(g: PropertyGraph, node_type: str, columns: Any) -> PropertyGraph:
    """Relationships that are a column of the type no longer are, once the column is changed."""

    def holds(t: EdgeTable) -> bool:
        return t.key is not None and {"src": t.src_type, "dst": t.dst_type}[t.key[0]] == node_type and t.key[1] in columns

    return replace(g, edges={n: tuple(replace(t, key=None) if holds(t) else t for t in ts) for n, ts in g.edges.items()})


def set_properties(g: PropertyGraph, node_type: str, values: Mapping[str, Any], where: Column | str | None = None) -> PropertyGraph:
    """SET on the nodes of a type; id and type cannot change."""
    if {"id", "type"} & set(values):
        raise ValueError("id and type cannot be set")
    g = _forget_keys(g, node_type, values)
    df = g.nodes[node_type]
    here = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    here = F.coalesce(here, F.lit(False))
    n = df.where(here).count() * len(values)
    for name, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        df = df.withColumn(name, F.when(here, v).otherwise(F.col(name) if name in df.columns else F.lit(None)))
    return g._next("set", {"properties_set": n}, nodes={**g.nodes, node_type: df})


def remove_property(g: PropertyGraph, node_type: str, name: str, where: Column | str | None = None) -> PropertyGraph:
    return set_properties(g, node_type, {name: F.lit(None)}, where)


def delete_nodes(g: PropertyGraph, node_type: str, ids: DataFrame, detach: bool = False) -> PropertyGraph:
    """Delete nodes (id); without detach it is an error if relationships remain."""
    ids = ids.select("id").distinct()
    edges, n_edges = {}, 0
    for name, tables in g.edges.items():
        out = []
        for t in tables:
            if node_type not in (t.src_type, t.dst_type):
                out.append(t)
                continue
            df = t.df
            for end, kind in (("src", t.src_type), ("dst", t.dst_type)):
                if kind == node_type:
                    df = df.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*t.df.columns)
            n_edges += t.df.count() - df.count() if detach else 0
            out.append(replace(t, df=df, key=None))
        edges[name] = tuple(out)
    if not detach:
        for name, tables in g.edges.items():
            for t in tables:
                for end, kind in (("src", t.src_type), ("dst", t.dst_type)):
                    if kind == node_type and not t.df.join(ids.withColumnRenamed("id", end), end, "left_semi").isEmpty():
                        raise ValueError(f"relationships of type {name} remain; delete with detach")
    df = g.nodes[node_type]
    n = df.join(ids, "id", "left_semi").count()
    return g._next("delete", {"nodes_deleted": n, "relationships_deleted": n_edges}, nodes={**g.nodes, node_type: df.join(ids, "id", "left_anti")}, edges=edges if detach else g.edges)


def delete_edges(g: PropertyGraph, edge_type: str, pairs: DataFrame) -> PropertyGraph:
    """Delete all relationships between pairs (src, dst)."""
    pairs = pairs.select("src", "dst").distinct()
    tables = tuple(replace(t, df=t.df.join(pairs, ["src", "dst"], "left_anti").select(*t.df.columns), key=None) for t in g.edges[edge_type])
    n = sum(t.df.count() - new.df.count() for t, new in zip(g.edges[edge_type], tables, strict=True))
    return g._next("delete_edges", {"relationships_deleted": n}, edges={**g.edges, edge_type: tables})


def merge_nodes(g: PropertyGraph, node_type: str, rows: DataFrame, key: list[str], on_create: Mapping[str, Any] | None = None, on_match: Mapping[str, Any] | None = None) -> PropertyGraph:
    """MERGE: nodes that agree in key are matched, others created once per key."""
    keys = rows.select(*key).dropDuplicates()
    old = g.nodes[node_type]
    if on_match:
        hit = keys.withColumn("_hit", F.lit(True))
        df = old.join(hit, key, "left")
        for name, v in on_match.items():
            v = v if isinstance(v, Column) else F.lit(v)
            df = df.withColumn(name, F.when(F.col("_hit"), v).otherwise(F.col(name) if name in df.columns else F.lit(None)))
        g = replace(g, nodes={**g.nodes, node_type: df.drop("_hit")})
    new = keys.join(old, key, "left_anti")
    for name, v in (on_create or {}).items():
        new = new.withColumn(name, v if isinstance(v, Column) else F.lit(v))
    return create_nodes(g, node_type, new, "title" if "title" in new.columns else None)


def merge_edges(g: PropertyGraph, edge_type: str, src_type: str, dst_type: str, pairs: DataFrame) -> PropertyGraph:
    pairs = pairs.dropDuplicates(["src", "dst"])
    for t in g.edges.get(edge_type, ()):
        if (t.src_type, t.dst_type) == (src_type, dst_type):
            pairs = pairs.join(t.df.select("src", "dst"), ["src", "dst"], "left_anti")
    return create_edges(g, edge_type, src_type, dst_type, pairs)


class Transaction:
    """A snapshot to change; commit() gives the new graph if the store has not moved on since begin()."""

    def __init__(self, store: Store, read_only: bool = False):
        self.store, self.graph, self.read_only, self.began = store, store.graph, read_only, store.graph.version

    def apply(self, change, *args: Any, **kwargs: Any) -> PropertyGraph:
        if self.read_only:
            raise PermissionError("the transaction is read-only")
        self.graph = change(self.graph, *args, **kwargs)
        return self.graph

    def commit(self) -> PropertyGraph:
        if self.store.graph.version != self.began:
            raise RuntimeError("the graph has changed since the transaction began")
        self.store.graph = self.graph
        return self.graph

    def rollback(self) -> None:
        self.graph = self.store.graph


class Store:
    """The current version of a graph."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def begin(self, read_only: bool = False) -> Transaction:
        return Transaction(self, read_only)
