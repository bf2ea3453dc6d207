"""Selections: a chain of levels, one key column per level, that grows by traversal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.catalog import EdgeTable, PropertyGraph
from weftgraph.functions import dates, spatial, vectors
from weftgraph.functions.predicates import any_condition, conditions
from weftgraph.operators import mutate, paths, rows


@dataclass(frozen=True)
class Selection:
    """keys: l0, l1, ... with the ids of an ancestor chain per row; types: the node type of each level."""

    graph: PropertyGraph
    keys: DataFrame
    types: tuple[str, ...]

    # ------------------------------------------------------------ basics

    @property
    def leaf(self) -> str:
        return f"l{len(self.types) - 1}"

    @property
    def type(self) -> str:
        return self.types[-1]

    def nodes(self) -> DataFrame:
        """The nodes of the last level, each once."""
        ids = self.keys.select(F.col(self.leaf).alias("id")).distinct()
        return self.graph.nodes[self.type].join(ids, "id", "left_semi")

    def chains(self) -> DataFrame:
        """The chains with the last level's properties beside their keys."""
        table = self.graph.nodes[self.type]
        return self.keys.join(table, F.col(self.leaf) == table.id).drop("id").withColumn("id", F.col(self.leaf))

    def _keep(self, nodes: DataFrame) -> Selection:
        ids = nodes.select(F.col("id").alias(self.leaf)).distinct()
        return replace(self, keys=self.keys.join(ids, self.leaf, "left_semi").select(*self.keys.columns))

    def count(self) -> int:
        return self.nodes().count()

    def ids(self) -> DataFrame:
        return self.keys.select(F.col(self.leaf).alias("id")).distinct()

    def titles(self) -> DataFrame:
        return self.nodes().select("title")

    # ------------------------------------------------------------ filters

    def where(self, wanted: Mapping[str, Any] | Column | str) -> Selection:
        n = self.nodes()
        return self._keep(n.where(conditions(n, wanted) if isinstance(wanted, Mapping) else wanted))

    def where_any(self, wanted: Sequence[Mapping[str, Any]]) -> Selection:
        n = self.nodes()
        return self._keep(n.where(any_condition(n, wanted)))

    def where_connected(self, edge: str, direction: str = "both", negate: bool = False) -> Selection:
        ends = None
        for _, t in self.graph.edge_pairs(edge):
            for end, kind, way in (("src", t.src_type, "out"), ("dst", t.dst_type, "in")):
                if kind == self.type and direction in (way, "both"):
                    e = t.df.select(F.col(end).alias("id"))
                    ends = e if ends is None else ends.union(e)
        if ends is None:
            return self if negate else self._keep(self.nodes().limit(0))
        return self._keep(self.nodes().join(ends, "id", "left_anti" if negate else "left_semi"))

    def where_orphans(self) -> Selection:
        out = self
        for name in self.graph.edge_types:
            out = out.where_connected(name, negate=True)
        return out

    def valid_at(self, day: Column, start: str | None = None, end: str | None = None) -> Selection:
        a, b = self._period(start, end)
        return self._keep(self.nodes().where(dates.valid_at(day, F.col(a), F.col(b))))

    def valid_during(self, first: Column, last: Column, start: str | None = None, end: str | None = None) -> Selection:
        a, b = self._period(start, end)
        return self._keep(self.nodes().where(dates.valid_during(first, last, F.col(a), F.col(b))))

    def _period(self, start: str | None, end: str | None) -> tuple[str, str]:
        declared = self.graph.info[self.type].temporal
        if start and end:
            return start, end
        if not declared:
            raise ValueError(f"{self.type} has no period of validity")
        return declared

    def within_bounds(self, south: float, west: float, north: float, east: float) -> Selection:
        lat, lon = self._place()
        return self._keep(self.nodes().where(spatial.within_bounds(F.col(lat), F.col(lon), south, west, north, east)))

    def near_point(self, lat: float, lon: float, metres: float) -> Selection:
        a, o = self._place()
        n = self.nodes()
        d = spatial.distance(F.col(a), F.col(o), F.lit(float(lat)), F.lit(float(lon)))
        return self._keep(n.where(spatial.haversine(F.col(a), F.col(o), F.lit(float(lat)), F.lit(float(lon))) <= metres * 1.01).where(d <= metres))

    def near_point_degrees(self, lat: float, lon: float, degrees: float) -> Selection:
        a, o = self._place()
        return self._keep(self.nodes().where(F.hypot(F.col(a) - lat, F.col(o) - lon) <= degrees))

    def contains_point(self, lat: float, lon: float) -> Selection:
        g = self.graph.info[self.type].spatial["geometry"]
        return self._keep(self.nodes().where(spatial.contains_point(F.col(g), F.lit(float(lat)), F.lit(float(lon)))))

    def intersects_geometry(self, wkt: str) -> Selection:
        g = self.graph.info[self.type].spatial["geometry"]
        return self._keep(self.nodes().where(spatial.intersects(F.col(g), F.lit(wkt))))

    def _place(self) -> tuple[str, str]:
        s = self.graph.info[self.type].spatial
        return s["lat"], s["lon"]

    def bounds(self) -> DataFrame:
        lat, lon = self._place()
        return self.nodes().agg(F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))

    def centroid(self) -> DataFrame:
        lat, lon = self._place()
        return self.nodes().agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))

    # ------------------------------------------------------------ order

    def limit(self, n: int, *keys, offset: int = 0) -> Selection:
        """n per parent group, by keys or else by id."""
        parents = [c for c in self.keys.columns if c != self.leaf][-1:]
        c = self.chains()
        out = rows.per_group(c, parents, [*keys, "id"], n, offset) if parents else rows.top(c, n, *keys, "id", skip=offset)
        return replace(self, keys=out.select(*self.keys.columns))

    # ------------------------------------------------------------ growth

    def traverse(self, edge: str, direction: str = "both", to: str | None = None, where: Mapping[str, Any] | None = None, where_edge: Mapping[str, Any] | None = None, limit: int | None = None, sort: Sequence = (), at: Column | None = None, during: tuple[Column, Column] | None = None, temporal: bool = True) -> Selection:
        """A new level of the nodes across a relationship; limit is per source. `at` keeps relationships and nodes that are
        valid on a day, `during` those valid at some time from its first to its last day; temporal=False asks for neither."""
        def valid(start: Column, end: Column) -> Column | None:
            if not temporal or at is None and during is None:
                return None
            return dates.valid_at(at, start, end) if at is not None else dates.valid_during(*during, start, end)

        found, kinds = None, set()
        for _, t in self.graph.edge_pairs(edge):
            for near, far, a, b, way in (("src", "dst", t.src_type, t.dst_type, "out"), ("dst", "src", t.dst_type, t.src_type, "in")):
                if a != self.type or direction not in (way, "both") or to not in (None, b):
                    continue
                e = t.df if where_edge is None else t.df.where(conditions(t.df, where_edge))
                periods = [p for p in self.graph.edge_temporal.get(edge, ()) if set(p) <= set(e.columns)]
                checks = [c for p in periods if (c := valid(F.col(p[0]), F.col(p[1]))) is not None]
                if checks:
                    e = e.where(reduce(lambda a, b: a | b, checks))
                e = e.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
                found = e if found is None else found.union(e)
                kinds.add(b)
        if len(kinds) != 1:
            raise ValueError(f"{edge} leads from {self.type} to {sorted(kinds) or 'nothing'}: name one type")
        new = f"l{len(self.types)}"
        keys = self.keys.join(found, F.col(self.leaf) == F.col("_near")).select(*self.keys.columns, F.col("_far").alias(new)).distinct()
        out = Selection(self.graph, keys, (*self.types, kinds.pop()))
        if where:
            out = out.where(where)
        if declared := self.graph.info[out.type].temporal if out.type in self.graph.info else None:
            ok = valid(F.col(declared[0]), F.col(declared[1]))
            out = out if ok is None else out._keep(out.nodes().where(ok))
        return out.limit(limit, *sort) if limit is not None else out

    def expand(self, hops: int = 1) -> DataFrame:
        """(type, id) of all nodes within some hops in any direction, the selection included."""
        e = self.graph.edge_table()
        e = e.select(F.concat_ws("\x00", "src_type", F.col("src").cast("string")).alias("src"), F.concat_ws("\x00", "dst_type", F.col("dst").cast("string")).alias("dst"))
        start = self.ids().select(F.concat(F.lit(f"{self.type}\x00"), F.col("id").cast("string")).alias("id"))
        found = paths.expand(e, start, hops)
        parts = F.split("id", "\x00")
        return found.select(parts[0].alias("type"), parts[1].alias("id"))

    def compare_distance(self, other: Selection, metres: float) -> DataFrame:
        """Pairs of the two selections within metres, with their distance."""
        lat, lon = self._place()
        lat2, lon2 = other._place()
        a = self.nodes().select("id", F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        b = other.nodes().select("id", F.col(lat2).alias("lat"), F.col(lon2).alias("lon"))
        return spatial.distance_join(a, b, metres)

    def compare_contains(self, other: Selection, cell: float = 1.0) -> DataFrame:
        """(a_id, b_id): shapes of this selection with the points of the other in them."""
        g = self.graph.info[self.type].spatial["geometry"]
        lat, lon = other._place()
        a = self.nodes().select(F.col("id").alias("a_id"), F.col(g).alias("_w"))
        b = other.nodes().select(F.col("id").alias("b_id"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
        return spatial.containment_join(a, b, "_w", "_lat", "_lon", cell).select("a_id", "b_id")

    def vector_search(self, name: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
        v = self.graph.embeddings[(self.type, name)]
        return vectors.search(self.nodes().join(v, "id"), "vector", query, k, metric)

    # ------------------------------------------------------------ sets

    def union(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids().union(other.ids()).distinct().toDF("l0"), (self.type,))

    def intersection(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids().join(other.ids(), "id", "left_semi").toDF("l0"), (self.type,))

    def difference(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids().join(other.ids(), "id", "left_anti").toDF("l0"), (self.type,))

    def symmetric_difference(self, other: Selection) -> Selection:
        return self.difference(other).union(other.difference(self))

    # ------------------------------------------------------------ sums

    def statistics(self, name: str) -> DataFrame:
        """Per parent (all, at the first level): count, valid_count, sum, avg, min, max, std."""
        parents = [c for c in self.keys.columns if c != self.leaf][-1:]
        return rows.statistics(self.chains(), name, parents)

    def calculate(self, expression: str, name: str) -> DataFrame:
        """(id, name): arithmetic over properties; with an aggregate function, per parent."""
        parents = [c for c in self.keys.columns if c != self.leaf][-1:]
        c = self.chains()
        if any(f"{f}(" in expression for f in ("sum", "mean", "avg", "std", "min", "max", "count")):
            e = F.expr(expression.replace("mean(", "avg(").replace("std(", "stddev_samp("))
            return c.groupBy(*parents).agg(e.alias(name))
        return c.select("id", F.expr(expression).alias(name)).distinct()

    def count_by_parent(self) -> DataFrame:
        return self.keys.groupBy(f"l{len(self.types) - 2}").agg(F.count("*").alias("count"))

    def unique_values(self, name: str) -> DataFrame:
        parents = [c for c in self.keys.columns if c != self.leaf][-1:]
        return self.chains().groupBy(*parents).agg(F.array_sort(F.collect_set(name)).alias("values"))

    def collect_children(self, name: str, most: int | None = None, where: Mapping[str, Any] | None = None, sort: Sequence = (), limit: int | None = None) -> DataFrame:
        """(parent, children): the children's values as text; where, sort and limit (per parent) choose among them."""
        if where or limit is not None:
            chosen = self.where(where) if where else self
            return (chosen.limit(limit, *sort) if limit is not None else chosen).collect_children(name, most)
        return self.chains().groupBy(f"l{len(self.types) - 2}").agg(rows.join_texts(F.col(name), ", ", most).alias("children"))

    # ------------------------------------------------------------ changes

    def store(self, values: DataFrame, name: str) -> PropertyGraph:
        """Put (id, name) on the nodes of the last level."""
        table = self.graph.nodes[self.type]
        new = table.drop(name).join(values.select("id", name), "id", "left")
        return replace(self.graph, nodes={**self.graph.nodes, self.type: new})

    def update(self, values: Mapping[str, Any]) -> PropertyGraph:
        hit = self.ids().withColumn("_hit", F.lit(True))
        table = self.graph.nodes[self.type].join(hit, "id", "left")
        g = replace(self.graph, nodes={**self.graph.nodes, self.type: table})
        g = mutate.set_properties(g, self.type, values, F.col("_hit"))
        return replace(g, nodes={**g.nodes, self.type: g.nodes[self.type].drop("_hit")})

    def add_properties(self, level: int, copy: Mapping[str, str]) -> PropertyGraph:
        """Copy properties of an ancestor level to the last one: {new name: ancestor's property}."""
        up = self.graph.nodes[self.types[level]]
        got = self.keys.select(F.col(self.leaf).alias("id"), F.col(f"l{level}").alias("_up")).join(up.select(F.col("id").alias("_up"), *[F.col(c).alias(n) for n, c in copy.items()]), "_up")
        got = got.groupBy("id").agg(*[F.min(n).alias(n) for n in copy])
        table = self.graph.nodes[self.type].drop(*copy)
        return replace(self.graph, nodes={**self.graph.nodes, self.type: table.join(got, "id", "left")})

    def aggregate_up(self, level: int, values: Mapping[str, str]) -> PropertyGraph:
        """Put aggregates of the last level on an ancestor level: {name: "count(*)", "sum(x)", "mean(x)", "std(x)", ...}."""
        make = [F.expr(e.replace("mean(", "avg(").replace("std(", "stddev_samp(").replace("collect(", "collect_list(")).alias(n) for n, e in values.items()]
        sums = self.chains().groupBy(F.col(f"l{level}").alias("id")).agg(*make)
        kind = self.types[level]
        table = self.graph.nodes[kind].drop(*values).join(sums, "id", "left")
        return replace(self.graph, nodes={**self.graph.nodes, kind: table})

    def create_connections(self, edge: str, conflict: str = "update", properties: Mapping[str, tuple[int, str]] | None = None, source: int = 0, target: int = -1) -> PropertyGraph:
        """Relationships between two levels of each chain, from the first to the last one if not told otherwise. properties
        copies those of levels: {name: (level, property)}; of several chains between two nodes the least value stays."""
        last = len(self.types) + target if target < 0 else target
        rows = self.keys
        for name, (level, prop) in (properties or {}).items():
            up = self.graph.nodes[self.types[level]].select(F.col("id").alias("_id"), F.col(prop).alias(name))
            rows = rows.join(up, F.col(f"l{level}") == F.col("_id"), "left").drop("_id")
        ends = [F.col(f"l{source}").alias("src"), F.col(f"l{last}").alias("dst")]
        pairs = rows.groupBy(*ends).agg(*[F.min(n).alias(n) for n in properties]) if properties else rows.select(*ends).distinct()
        return self.graph.add_edges(pairs, edge, self.types[source], "src", self.types[last], "dst", mode=conflict, check=False)

    def connections(self, edge: str | None = None) -> DataFrame:
        """Relationships with an end in the selection."""
        ids, parts = self.ids(), None
        for name, t in self.graph.edge_pairs(edge):
            for end, kind in (("src", t.src_type), ("dst", t.dst_type)):
                if kind == self.type:
                    e = t.df.join(ids.withColumnRenamed("id", end), end, "left_semi").select(F.lit(name).alias("edge_type"), F.lit(t.src_type).alias("src_type"), F.col("src").cast("string").alias("src"), F.lit(t.dst_type).alias("dst_type"), F.col("dst").cast("string").alias("dst"))
                    parts = e if parts is None else parts.union(e)
        return parts.distinct()


def select(g: PropertyGraph, node_type: str, at: Column | None = None) -> Selection:
    """All nodes of a type; at keeps those valid on a day, if the type has a period of validity."""
    out = Selection(g, g.nodes[node_type].select(F.col("id").alias("l0")), (node_type,))
    return out.valid_at(at) if at is not None and g.info[node_type].temporal else out


def subgraph(g: PropertyGraph, ids: Mapping[str, DataFrame]) -> PropertyGraph:
    """The graph induced by some nodes (id) of each type: two semi joins per relationship table."""
    nodes = {t: g.nodes[t].join(i, "id", "left_semi") for t, i in ids.items()}
    edges = {}
    for name, t in g.edge_pairs():
        if t.src_type in ids and t.dst_type in ids:
            df = t.df.join(ids[t.src_type].withColumnRenamed("id", "src"), "src", "left_semi").join(ids[t.dst_type].withColumnRenamed("id", "dst"), "dst", "left_semi").select(*t.df.columns)
            edges[name] = (*edges.get(name, ()), EdgeTable(t.src_type, t.dst_type, df))
    return replace(g, nodes=nodes, edges=edges)
