"""What a graph holds: counts, schemas, connectivity, samples and a description."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.operators.integrity import RULES


def node_type_counts(g: PropertyGraph) -> DataFrame:
    out = None
    for t in g.node_types:
        df = g.nodes[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("type"), "n")
        out = df if out is None else out.union(df)
    return out


def connectivity(g: PropertyGraph) -> DataFrame:
    """(src_type, edge_type, dst_type, n)."""
    out = None
    for name, t in g.edge_pairs():
        df = t.df.agg(F.count("*").alias("n")).select(F.lit(t.src_type).alias("src_type"), F.lit(name).alias("edge_type"), F.lit(t.dst_type).alias("dst_type"), "n")
        out = df if out is None else out.union(df)
    return out


def edge_type_counts(g: PropertyGraph) -> DataFrame:
    return connectivity(g).groupBy("edge_type").agg(F.sum("n").alias("n"))


def properties(g: PropertyGraph, node_type: str, examples: int = 3) -> DataFrame:
    """(property, kind, filled, different, examples) in one pass over the type's table."""
    df = g.nodes[node_type]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]))
    return df.select(cells.alias("c")).select("c.*").groupBy("property", "kind").agg(F.count("value").alias("filled"), F.approx_count_distinct("value").alias("different"), F.slice(F.array_sort(F.collect_set(F.when(F.xxhash64("value") % 1000 == 0, F.col("value")))), 1, examples).alias("examples"))


def neighbors_schema(g: PropertyGraph, node_type: str) -> DataFrame:
    return connectivity(g).where((F.col("src_type") == node_type) | (F.col("dst_type") == node_type))


def sample(g: PropertyGraph, node_type: str, n: int = 5) -> DataFrame:
    return g.nodes[node_type].orderBy("id").limit(n)


def schema_text(g: PropertyGraph) -> str:
    lines = [f"{t}({', '.join(f'{c}: {k}' for c, k in g.nodes[t].dtypes)})" for t in g.node_types]
    lines += [f"({t.src_type})-[{name}{{{', '.join(t.properties)}}}]->({t.dst_type})" for name, t in g.edge_pairs()]
    return "\n".join(lines)


def describe(g: PropertyGraph) -> str:
    """An XML description of types, relationships and rules."""
    out = ["<graph>"]
    for t in g.node_types:
        out.append(f"  <type name={quoteattr(t)}>")
        out += [f"    <property name={quoteattr(c)} kind={quoteattr(k)}/>" for c, k in g.nodes[t].dtypes]
        out.append("  </type>")
    out += [f"  <connection name={quoteattr(n)} from={quoteattr(t.src_type)} to={quoteattr(t.dst_type)}/>" for n, t in g.edge_pairs()]
    out += [f"  <rule name={quoteattr(r)}/>" for r in sorted(RULES)]
    return "\n".join([*out, "</graph>"])


def search(g: PropertyGraph, value: str) -> DataFrame:
    """(type, id, title) of nodes of any type with a title."""
    return g.node_table().where(F.col("title") == value).select("type", "id", "title")
