"""The property graph: node and relationship tables with their metadata.

A graph is an immutable catalog of DataFrames. Every change returns a new graph that shares the tables it did not touch, so
a snapshot is a reference and a rollback is forgetting the newer one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How loads treat rows whose key is known: new values where present, all new, none, old values first, sums.
MODES = ("update", "replace", "skip", "preserve", "sum")


@dataclass(frozen=True)
class EdgeTable:
    """Relationships between two node types: src, dst and properties. Parallel ones are separate rows.

    key names the column of the src or dst node table that holds the other end's id, if that is all the relationship is.
    """

    src_type: str
    dst_type: str
    df: DataFrame
    key: tuple[str, str] | None = None  # ("src" | "dst", column)

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst")]


@dataclass(frozen=True)
class TypeInfo:
    """What is declared about a node type beyond its columns."""

    id_alias: str | None = None
    title_alias: str | None = None
    parent: str | None = None
    spatial: Mapping[str, str] = field(default_factory=dict)  # lat, lon, geometry
    temporal: tuple[str, str] | None = None  # valid_from, valid_to


@dataclass(frozen=True)
class Report:
    """What a change did."""

    operation: str
    counts: Mapping[str, int]


@dataclass(frozen=True)
class PropertyGraph:
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, tuple[EdgeTable, ...]] = field(default_factory=dict)
    info: Mapping[str, TypeInfo] = field(default_factory=dict)
    edge_temporal: Mapping[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    embeddings: Mapping[tuple[str, str], DataFrame] = field(default_factory=dict)  # (type, property) -> id, vector
    series: Mapping[str, DataFrame] = field(default_factory=dict)  # type -> id, date, channel, value
    schema: Mapping[str, Mapping[str, Any]] | None = None
    reports: tuple[Report, ...] = ()
    version: int = 0

    # ------------------------------------------------------------ loading

    def add_nodes(self, df: DataFrame, node_type: str, id_column: str, title_column: str | None = None, columns: Sequence[str] | None = None, skip_columns: Sequence[str] = (), mode: str = "update", unique: bool = False) -> PropertyGraph:
        """Register a table as a node type, or upsert it into one. Null ids are left out; ids are unique within a type.

        A property called type becomes type_. unique says that ids are so already, which saves the shuffle that would make them so.
        """
        _mode(mode)
        if "type" in df.columns:  # the built-in name of a node's type
            df = df.withColumnRenamed("type", "type_")
        keep = [c for c in columns or df.columns if c not in skip_columns and c not in (id_column, title_column)]
        title = F.col(title_column) if title_column else F.col(id_column)
        new = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), title.cast("string").alias("title"), *[F.col(c) for c in keep])
        new = new if unique else new.dropDuplicates(["id"])
        old = self.nodes.get(node_type)
        table = new if old is None else _upsert(old, new, ["id"], "update" if mode == "sum" else mode)
        info = self.info.get(node_type) or TypeInfo()
        info = replace(info, id_alias=info.id_alias or id_column, title_alias=info.title_alias or title_column)
        return self._next("add_nodes", nodes={**self.nodes, node_type: table}, info={**self.info, node_type: info})

    def add_edges(self, df: DataFrame, edge_type: str, src_type: str, src_column: str, dst_type: str, dst_column: str, columns: Sequence[str] | None = None, mode: str = "update", check: bool = True, key: tuple[str, str] | None = None) -> PropertyGraph:
        """Register relationships. Rows with null or unknown endpoints are left out (semi joins against the ids).

        The first load of a type keeps parallel relationships; later ones are upserts on (src, dst). key says that the rows
        are a foreign key: ("dst", "custkey") if the dst nodes have the src id in custkey. Patterns then join the node tables directly.
        """
        _mode(mode)
        keep = [c for c in (df.columns if columns is None else columns) if c not in (src_column, dst_column)]
        new = df.select(F.col(src_column).alias("src"), F.col(dst_column).alias("dst"), *keep).where("src is not null and dst is not null")
        if check:
            for end, kind in (("src", src_type), ("dst", dst_type)):
                ids = self.nodes[kind].select(F.col("id").alias(end))
                new = new.join(ids, end, "left_semi")
            new = new.select("src", "dst", *keep)
        tables = list(self.edges.get(edge_type, ()))
        for i, t in enumerate(tables):
            if (t.src_type, t.dst_type) == (src_type, dst_type):
                tables[i] = replace(t, df=_upsert(t.df, new, ["src", "dst"], mode), key=None)
                break
        else:
            tables.append(EdgeTable(src_type, dst_type, new, key))
        return self._next("add_edges", edges={**self.edges, edge_type: tuple(tables)})

    def add_nodes_bulk(self, specs: Iterable[Mapping[str, Any]]) -> PropertyGraph:
        g = self
        for s in specs:
            g = g.add_nodes(**s)
        return g

    def add_edges_bulk(self, specs: Iterable[Mapping[str, Any]], loaded_only: bool = False) -> PropertyGraph:
        """loaded_only leaves out specs whose endpoint types are not loaded."""
        g = self
        for s in specs:
            if not loaded_only or s["src_type"] in g.nodes and s["dst_type"] in g.nodes:
                g = g.add_edges(**s)
        return g

    # ------------------------------------------------------------ metadata

    def set_spatial(self, node_type: str, lat: str | None = None, lon: str | None = None, geometry: str | None = None) -> PropertyGraph:
        spec = {k: v for k, v in (("lat", lat), ("lon", lon), ("geometry", geometry)) if v}
        return self._describe(node_type, spatial=spec)

    def set_temporal(self, kind: str, valid_from: str, valid_to: str) -> PropertyGraph:
        """For a node type its period of validity; for a relationship type one of possibly several."""
        if kind in self.edges:
            return replace(self, edge_temporal={**self.edge_temporal, kind: (*self.edge_temporal.get(kind, ()), (valid_from, valid_to))})
        return self._describe(kind, temporal=(valid_from, valid_to))

    def set_parent(self, node_type: str, parent: str) -> PropertyGraph:
        return self._describe(node_type, parent=parent)

    def set_embeddings(self, node_type: str, name: str, vectors: DataFrame) -> PropertyGraph:
        """vectors: id, vector."""
        return replace(self, embeddings={**self.embeddings, (node_type, name): vectors.select("id", "vector")})

    def remove_embeddings(self, node_type: str, name: str) -> PropertyGraph:
        return replace(self, embeddings={k: v for k, v in self.embeddings.items() if k != (node_type, name)})

    def set_series(self, node_type: str, series: DataFrame) -> PropertyGraph:
        """series: id, date, channel, value."""
        return replace(self, series={**self.series, node_type: series.select("id", "date", "channel", "value")})

    def _describe(self, node_type: str, **changes: Any) -> PropertyGraph:
        return replace(self, info={**self.info, node_type: replace(self.info.get(node_type) or TypeInfo(), **changes)})

    def _next(self, operation: str, counts: Mapping[str, int] | None = None, **changes: Any) -> PropertyGraph:
        return replace(self, version=self.version + 1, reports=(*self.reports, Report(operation, counts or {})), **changes)

    # ------------------------------------------------------------ tables

    @property
    def node_types(self) -> list[str]:
        return sorted(self.nodes)

    @property
    def edge_types(self) -> list[str]:
        return sorted(self.edges)

    def node_table(self, node_type: str | None = None) -> DataFrame:
        """type, id, title and properties of a node type; of all types if none is named (missing properties are null)."""
        if node_type is not None:
            df = self.nodes[node_type]
            return df.select(F.lit(node_type).alias("type"), *df.columns)
        tables = [self.node_table(t) for t in self.node_types]
        return _union_all(tables, {"id": "string"} if len({dict(t.dtypes)["id"] for t in tables}) > 1 else {})

    def edge_table(self, edge_types: str | Sequence[str] | None = None, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
        """edge_type, src_type, src, dst_type, dst and properties of the relationships of some or all types."""
        names = self.edge_types if edge_types is None else [edge_types] if isinstance(edge_types, str) else list(edge_types)
        tables = []
        for name in names:
            for t in self.edges.get(name, ()):
                if src_type in (None, t.src_type) and dst_type in (None, t.dst_type):
                    tables.append(t.df.select(F.lit(name).alias("edge_type"), F.lit(t.src_type).alias("src_type"), "src", F.lit(t.dst_type).alias("dst_type"), "dst", *t.properties))
        if not tables:
            some = next(iter(self.nodes.values())) if self.nodes else None
            if some is None:
                raise ValueError("the graph has no tables")
            null = F.lit(None)
            return some.limit(0).select(null.cast("string").alias("edge_type"), null.cast("string").alias("src_type"), F.col("id").alias("src"), null.cast("string").alias("dst_type"), F.col("id").alias("dst"))
        kinds = {dict(t.dtypes)[c] for t in tables for c in ("src", "dst")}
        return _union_all(tables, {"src": "string", "dst": "string"} if len(kinds) > 1 else {})

    def edge_pairs(self, edge_types: str | Sequence[str] | None = None) -> list[tuple[str, EdgeTable]]:
        names = self.edge_types if edge_types is None else [edge_types] if isinstance(edge_types, str) else list(edge_types)
        return [(n, t) for n in names for t in self.edges.get(n, ())]

    def resolve(self, node_type: str | None, name: str) -> str:
        """The column of a property: built-in names and the loaded names of id and title come first."""
        if name in ("name", "label") and node_type and name in self.nodes[node_type].columns:
            return name
        built_in = {"node_type": "type", "label": "type", "name": "title"}.get(name, name)
        info = self.info.get(node_type or "")
        if info and name == info.id_alias and name not in self.nodes[node_type].columns:
            return "id"
        if info and name == info.title_alias and name not in self.nodes[node_type].columns:
            return "title"
        return built_in


def _mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


def _upsert(old: DataFrame, new: DataFrame, key: list[str], mode: str) -> DataFrame:
    """One sort by the key, each new row before the old ones; each column takes the side that the mode prefers.

    Of new rows with one key the first counts; old ones with one key all stay.
    """
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    held = [[F.lit(True).alias("_is"), *[F.col(c) for c in df.columns if c not in key]] for df in (old, new)]
    o = old.select(*key, F.lit(1).alias("_side"), F.struct(*held[0]).alias("_old"))
    n = new.select(*key, F.lit(0).alias("_side"), F.struct(*held[1]).alias("_new"))
    group = Window.partitionBy(*key).orderBy("_side")
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = o.unionByName(n, allowMissingColumns=True).select(*key, "_side", "_old", F.first("_new").over(so_far).alias("_new"), F.count("*").over(so_far).alias("_n"), F.max("_side").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    # a new row goes if an old one follows, which takes its values, or if it is a repeat
    both = both.where((F.col("_side") == 1) | ((F.col("_n") == 1) & (F.col("_last") == 0)))
    kinds = dict(new.dtypes) | dict(old.dtypes)
    known = F.col("_old").isNotNull()
    out: list[Column] = []
    for c in columns:
        if c in key:
            out.append(F.col(c))
            continue
        a = F.col(f"_old.{c}") if c in old.columns else F.lit(None).cast(kinds[c])
        b = F.col(f"_new.{c}").cast(kinds[c]) if c in new.columns else F.lit(None).cast(kinds[c])
        if mode == "replace":
            v = F.when(F.col("_new").isNotNull(), b).otherwise(a)
        elif mode == "skip":
            v = F.when(known, a).otherwise(b)
        elif mode == "preserve":
            v = F.coalesce(a, b)
        elif mode == "sum" and kinds[c] in ("int", "bigint", "float", "double", "smallint"):
            v = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        else:
            v = F.coalesce(b, a)
        out.append(v.alias(c))
    return both.select(*out)


def _union_all(tables: list[DataFrame], casts: Mapping[str, str]) -> DataFrame:
    """Union by name; a column of different types is widened: to bigint or double where numeric, else to string."""
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for c, k in t.dtypes:
            kinds.setdefault(c, set()).add(k)
    wide = dict(casts)
    for c, k in kinds.items():
        if len(k) > 1 and c not in wide:
            wide[c] = "bigint" if k <= {"int", "bigint", "smallint"} else "double" if k <= {"int", "bigint", "smallint", "float", "double"} else "string"
    out = None
    for t in tables:
        t = t.select(*[F.col(c).cast(wide[c]).alias(c) if c in wide else F.col(c) for c in t.columns])
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
