"""Graph patterns as chains of joins.

A pattern is built from node() and its steps; match() returns a DataFrame with one struct column per variable, to be used
like any other: `matched.where("o.totalprice > 1000").groupBy("c.segment").count()`. The optimiser sees plain joins of
projected tables, so filters on a struct's fields reach the scans and unused properties are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions.predicates import condition

#: The longest walk of a step without an upper bound.
MAX_HOPS = 10


@dataclass(frozen=True)
class NodeStep:
    var: str
    type: str | None = None
    props: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeStep:
    types: tuple[str, ...] | None
    direction: str  # out, in, both
    var: str | None = None
    hops: tuple[int, int] | None = None
    props: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pattern:
    steps: tuple[NodeStep | EdgeStep, ...]

    def out(self, edge: str | Sequence[str] | None, to: str, type: str | None = None, **k: Any) -> Pattern:
        return self._step(edge, "out", to, type, **k)

    def into(self, edge: str | Sequence[str] | None, to: str, type: str | None = None, **k: Any) -> Pattern:
        return self._step(edge, "in", to, type, **k)

    def both(self, edge: str | Sequence[str] | None, to: str, type: str | None = None, **k: Any) -> Pattern:
        return self._step(edge, "both", to, type, **k)

    def _step(self, edge, direction, to, type, var: str | None = None, hops: tuple[int, int | None] | int | None = None, where: Mapping[str, Any] | None = None, **props: Any) -> Pattern:
        kinds = None if edge is None else (edge,) if isinstance(edge, str) else tuple(edge)
        if isinstance(hops, int):
            hops = (hops, hops)
        elif hops is not None:
            hops = (hops[0], MAX_HOPS if hops[1] is None else hops[1])
        return Pattern((*self.steps, EdgeStep(kinds, direction, var, hops, where or {}), NodeStep(to, type, props)))

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(s.var for s in self.steps if s.var))


@dataclass(frozen=True)
class Ref:
    """The property of another variable of the pattern, as the value that a property must equal."""

    var: str
    prop: str


def node(var: str, type: str | None = None, **props: Any) -> Pattern:
    """A pattern of one node; props are equalities on its properties (lists: any of them), {operator: value} conditions as in
    selections ({">": 5}, {"between": (1, 2)}, {"starts_with": "a"}), or a Ref to another variable's property."""
    return Pattern((NodeStep(var, type, props),))


def _fits(df: DataFrame, name: str, value: Any) -> Column:
    """The condition on a property; one on another variable is left to _compared."""
    if isinstance(value, Ref):
        return F.lit(True)
    if isinstance(value, Mapping):
        return condition(df, name, value)
    if isinstance(value, (list, tuple, set)):
        return F.col(name).isin(*value)
    return F.col(name) == (value if isinstance(value, Column) else F.lit(value))


def _compared(g: PropertyGraph, p: Pattern, rows: DataFrame) -> DataFrame:
    """rows whose properties equal those of other variables, where the pattern says so."""
    types = {s.var: s.type for s in p.steps if isinstance(s, NodeStep)}
    for s in p.steps:
        name = s.var
        for prop, value in s.props.items():
            if isinstance(value, Ref):
                if name not in rows.columns or value.var not in rows.columns:
                    raise ValueError(f"the pattern has no variable {name if name not in rows.columns else value.var}")
                column = g.resolve(s.type, prop) if isinstance(s, NodeStep) else prop
                rows = rows.where(F.col(f"{name}.{column}") == F.col(f"{value.var}.{g.resolve(types.get(value.var), value.prop)}"))
    return rows


def _nodes(g: PropertyGraph, s: NodeStep) -> DataFrame:
    df = g.node_table(s.type)
    for name, value in s.props.items():
        column = g.resolve(s.type, name)
        if column not in df.columns:
            raise ValueError(f"{s.type or 'no node type'} has no property {name}")
        df = df.where(_fits(df, column, value))
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias(s.var))


def _edges(g: PropertyGraph, e: EdgeStep, left: str | None, right: str | None, name: str) -> DataFrame:
    """_l, _r (with their types) and the relationship's struct, from the point of view of the step."""
    ways = []
    if e.direction in ("out", "both"):
        ways.append(("src", "dst", g.edge_table(e.types, left, right)))
    if e.direction in ("in", "both"):
        ways.append(("dst", "src", g.edge_table(e.types, right, left)))
    out = None
    for near, far, df in ways:
        for p, value in e.props.items():
            df = df.where(_fits(df, p, value)) if p in df.columns else df.where(F.lit(False))
        df = df.select(F.col(near).alias("_l"), F.col(f"{near}_type").alias("_lt"), F.col(far).alias("_r"), F.col(f"{far}_type").alias("_rt"), F.struct(*[F.col(c) for c in df.columns]).alias(name))
        out = df if out is None else out.unionByName(df)
    return out


def walks(edges: DataFrame, sources: DataFrame, least: int, most: int) -> DataFrame:
    """(source, target, depth): walks of least to most steps along edges (_l, _r) from sources (source).

    Each level keeps a target once per source, so a level's size is bounded by pairs, not by the number of walks.
    """
    hop = edges.select("_l", "_r").distinct()
    level = sources.select("source", F.col("source").alias("target")).distinct()
    out = level.withColumn("depth", F.lit(0)) if least == 0 else None
    for depth in range(1, most + 1):
        level = level.join(hop, level.target == hop._l).select("source", F.col("_r").alias("target")).distinct()
        if depth >= least:
            found = level.withColumn("depth", F.lit(depth))
            out = found if out is None else out.unionByName(found)
    return out


_fresh = itertools.count()


def match(g: PropertyGraph, *patterns: Pattern, rows: DataFrame | None = None) -> DataFrame:
    """All bindings of the patterns' variables, joined on the variables they share, and with those of rows.

    Patterns that share none are a product. Matching is homomorphic: different variables may bind the same
    node or relationship.
    """
    for p in patterns:
        rows = _compared(g, p, _expand(g, p, rows))
    return rows


def optional_match(g: PropertyGraph, rows: DataFrame, pattern: Pattern) -> DataFrame:
    """rows with the pattern's new variables, null where it does not match."""
    shared = [v for v in pattern.variables if v in rows.columns]
    if not shared:
        return rows.join(_compared(g, pattern, _expand(g, pattern, None)), F.lit(True), "left")
    found = _compared(g, pattern, _expand(g, pattern, None))
    keys = [(f"{v}.{k}", f"_k{i}{k}") for i, v in enumerate(shared) for k in _key(found, v)]
    right = found.select(*[F.col(a).alias(b) for a, b in keys], *[v for v in pattern.variables if v not in shared])
    on = None
    for a, b in keys:
        c = F.col(a) == F.col(b)
        on = c if on is None else on & c
    return rows.join(right, on, "left").drop(*[b for _, b in keys])


def _key(df: DataFrame, var: str) -> list[str]:
    fields = df.schema[var].dataType.fieldNames()
    return ["type", "id"] if "id" in fields else ["edge_type", "src", "dst"]


def exists(g: PropertyGraph, rows: DataFrame, pattern: Pattern, where: Column | str | None = None, negate: bool = False) -> DataFrame:
    """The rows for which the pattern has (negate: has no) match with their variables, by a semi or anti join."""
    found, on = _subquery(g, rows, pattern, where)
    return rows.join(found.dropDuplicates(), on, "left_anti" if negate else "left_semi")


def count_pattern(g: PropertyGraph, rows: DataFrame, pattern: Pattern, name: str, where: Column | str | None = None) -> DataFrame:
    """rows with the number of the pattern's matches for each."""
    found, on = _subquery(g, rows, pattern, where)
    keys = found.columns
    n = found.groupBy(*keys).agg(F.count("*").alias(name))
    return rows.join(n, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0))).drop(*keys)


def _subquery(g: PropertyGraph, rows: DataFrame, pattern: Pattern, where):
    shared = [v for v in pattern.variables if v in rows.columns]
    if not shared:
        raise ValueError("the pattern shares no variable with the rows")
    found = _compared(g, pattern, _expand(g, pattern, None))
    if where is not None:
        found = found.where(where)
    keys = [(f"{v}.{k}", f"_k{i}{k}") for i, v in enumerate(shared) for k in _key(found, v)]
    on = None
    for a, b in keys:
        c = F.col(a) == F.col(b)
        on = c if on is None else on & c
    return found.select(*[F.col(a).alias(b) for a, b in keys]), on


def _expand(g: PropertyGraph, p: Pattern, rows: DataFrame | None) -> DataFrame:
    first = p.steps[0]
    bound = set(rows.columns) if rows is not None else set()
    if first.var in bound:
        out = _narrow(g, rows, first)
    else:
        shared = [s for s in p.steps if isinstance(s, NodeStep) and s.var in bound]
        out = _nodes(g, first)
        if rows is not None and not shared:
            out = rows.crossJoin(out)
        elif rows is not None:
            # later steps join the incoming rows: begin at the shared variable instead
            i = next(i for i, s in enumerate(p.steps) if isinstance(s, NodeStep) and s.var in bound)
            back = Pattern(tuple(_turn(s) for s in reversed(p.steps[: i + 1])))
            rows = _expand(g, back, rows)
            return _expand(g, Pattern(p.steps[i:]), rows) if i + 1 < len(p.steps) else rows
    types = {s.var: s.type for s in p.steps if isinstance(s, NodeStep) and s.type}
    for i in range(1, len(p.steps), 2):
        out = _hop(g, out, p.steps[i - 1], p.steps[i], p.steps[i + 1], types)
    return out


def _turn(s: NodeStep | EdgeStep) -> NodeStep | EdgeStep:
    return replace(s, direction={"out": "in", "in": "out", "both": "both"}[s.direction]) if isinstance(s, EdgeStep) else s


def _narrow(g: PropertyGraph, rows: DataFrame, s: NodeStep) -> DataFrame:
    if s.type:
        rows = rows.where(F.col(f"{s.var}.type") == s.type)
    for name, value in s.props.items():
        rows = rows.where(_fits(rows, f"{s.var}.{g.resolve(s.type, name)}", value))
    return rows


def _hop(g: PropertyGraph, rows: DataFrame, a: NodeStep, e: EdgeStep, b: NodeStep, types: Mapping[str, str]) -> DataFrame:
    name = e.var or f"_e{next(_fresh)}"
    left, right = types.get(a.var), types.get(b.var)
    if e.hops is not None:
        return _walk(g, rows, a, e, b, right)
    if b.var not in rows.columns and (near := _foreign_key(g, e, left, right)):
        side, column = near
        far = _nodes(g, b)
        on = F.col(f"{a.var}.{column}") == F.col(f"{b.var}.id") if side == "near" else F.col(f"{a.var}.id") == F.col(f"{b.var}.{column}")
        return rows.join(far, on)
    edges = _edges(g, e, left, right, name)
    if not left:
        on = (F.col(f"{a.var}.id").cast("string") == F.col("_l").cast("string")) & (F.col(f"{a.var}.type") == F.col("_lt"))
    else:
        on = F.col(f"{a.var}.id") == F.col("_l")
    # rows that are only nodes, whose ids are unique, are the table of a hash join, so that the many edges are not sorted
    out = (rows.hint("shuffle_hash") if not right and rows.columns == [a.var] else rows).join(edges, on)
    if b.var in rows.columns:
        out = _narrow(g, out, b).where((F.col(f"{b.var}.id") == F.col("_r")) & (F.col(f"{b.var}.type") == F.col("_rt")))
    else:
        far = _nodes(g, b)
        on = F.col(f"{b.var}.id") == F.col("_r")
        if not right:
            on = (F.col(f"{b.var}.id").cast("string") == F.col("_r").cast("string")) & (F.col(f"{b.var}.type") == F.col("_rt"))
        out = out.join(far, on)
    drop = ["_l", "_lt", "_r", "_rt", *([] if e.var else [name])]
    return out.drop(*drop)


def _foreign_key(g: PropertyGraph, e: EdgeStep, left: str | None, right: str | None) -> tuple[str, str] | None:
    """("near" | "far", column) if the step only follows a column of one of its ends' tables."""
    if e.var or e.props or not (left and right) or e.direction == "both" or not e.types or len(e.types) != 1:
        return None
    ends = (left, right) if e.direction == "out" else (right, left)
    tables = [t for t in g.edges.get(e.types[0], ()) if (t.src_type, t.dst_type) == ends]
    if len(tables) != 1 or tables[0].key is None:
        return None
    side, column = tables[0].key
    near = (side == "src") == (e.direction == "out")
    return ("near" if near else "far", column)


def _walk(g: PropertyGraph, rows: DataFrame, a: NodeStep, e: EdgeStep, b: NodeStep, right: str | None) -> DataFrame:
    """A step of several hops: depth is bound to `<var>` if the relationship is named (as its number of hops)."""
    edges = _edges(g, e, None, None, "_e").drop("_e")
    edges = edges.select(F.concat_ws("\x00", "_lt", F.col("_l").cast("string")).alias("_l"), F.concat_ws("\x00", "_rt", F.col("_r").cast("string")).alias("_r"))

    def key(var: str) -> Column:
        return F.concat_ws("\x00", F.col(f"{var}.type"), F.col(f"{var}.id").cast("string"))

    found = walks(edges, rows.select(key(a.var).alias("source")), *e.hops)
    out = rows.withColumn("_s", key(a.var)).join(found, F.col("_s") == F.col("source")).drop("_s", "source")
    if b.var in rows.columns:
        out = _narrow(g, out, b).where(key(b.var) == F.col("target"))
    else:
        out = out.join(_nodes(g, b).withColumn("_t", key(b.var)), F.col("_t") == F.col("target")).drop("_t")
    out = out.drop("target")
    return out.withColumnRenamed("depth", e.var) if e.var else out.drop("depth")
