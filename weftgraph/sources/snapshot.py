"""Snapshots and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import EdgeTable, PropertyGraph, TypeInfo
from weftgraph.operators.shared import cut


def save(g: PropertyGraph, spark: SparkSession, path: str) -> None:
    """A folder of Parquet tables and a description, by Spark's own file systems."""
    meta: dict = {"nodes": [], "edges": [], "info": {}, "embeddings": [], "series": [], "version": 1}
    for t, df in g.nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{t}")
        meta["nodes"].append(t)
    for i, (name, t) in enumerate(g.edge_pairs()):
        t.df.write.mode("overwrite").parquet(f"{path}/edges/{i}")
        meta["edges"].append([name, t.src_type, t.dst_type])
    for t, i in g.info.items():
        meta["info"][t] = {"id_alias": i.id_alias, "title_alias": i.title_alias, "parent": i.parent, "spatial": dict(i.spatial), "temporal": i.temporal}
    for i, ((t, p), df) in enumerate(g.embeddings.items()):
        df.write.mode("overwrite").parquet(f"{path}/embeddings/{i}")
        meta["embeddings"].append([t, p])
    for t, df in g.series.items():
        df.write.mode("overwrite").parquet(f"{path}/series/{t}")
        meta["series"].append(t)
    meta["edge_temporal"] = {k: [list(p) for p in v] for k, v in g.edge_temporal.items()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> PropertyGraph:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    edges: dict[str, tuple[EdgeTable, ...]] = {}
    for i, (name, a, b) in enumerate(meta["edges"]):
        edges[name] = (*edges.get(name, ()), EdgeTable(a, b, spark.read.parquet(f"{path}/edges/{i}")))
    info = {t: TypeInfo(i["id_alias"], i["title_alias"], i["parent"], i["spatial"], tuple(i["temporal"]) if i["temporal"] else None) for t, i in meta["info"].items()}
    return PropertyGraph(
        nodes={t: spark.read.parquet(f"{path}/nodes/{t}") for t in meta["nodes"]}, edges=edges, info=info,
        edge_temporal={k: tuple(tuple(p) for p in v) for k, v in meta["edge_temporal"].items()},
        embeddings={(t, p): spark.read.parquet(f"{path}/embeddings/{i}") for i, (t, p) in enumerate(meta["embeddings"])},
        series={t: spark.read.parquet(f"{path}/series/{t}") for t in meta["series"]},
    )


def export_csv(g: PropertyGraph, path: str) -> None:
    """A folder of CSV files per node and relationship type."""
    for t, df in g.nodes.items():
        _flat(df).write.mode("overwrite").option("header", True).csv(f"{path}/nodes/{t}")
    for name, t in g.edge_pairs():
        _flat(t.df).write.mode("overwrite").option("header", True).csv(f"{path}/edges/{name}_{t.src_type}_{t.dst_type}")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes])


def _xml(c: Column) -> Column:
    """Text for XML, in elements and in attributes; characters that XML cannot hold go."""
    c = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _key(kind: str, end: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(end).cast("string"))


def _data(df: DataFrame, names: Sequence[str], tag: str, name: str, value: str) -> Column:
    """One element for each property that is not null."""
    flat = _flat(df.select(*names)) if names else df
    kinds = dict(flat.dtypes)
    texts = [F.to_json(F.col(c)) if dict(df.dtypes)[c] != kinds[c] else F.col(c).cast("string") for c in names]
    parts = [F.concat(F.lit(f"<{tag} {name}={quoteattr(c)}{value}"), _xml(t), F.lit(f'"/>' if value.endswith('"') else f"</{tag}>")) for c, t in zip(names, texts, strict=True)]
    return F.concat_ws("", *parts) if parts else F.lit("")


def _lines(g: PropertyGraph, kind: str) -> DataFrame:
    """(part, key, line): one line for each node (part 1) and relationship (part 2)."""
    out = []
    for t in g.node_types:
        df = g.nodes[t]
        rest = [c for c in df.columns if c not in ("id", "title")]
        key, title = _key(t, "id"), F.coalesce(F.col("title").cast("string"), F.lit(""))
        if kind == "d3":
            line = F.to_json(F.struct(key.alias("id"), F.lit(t).alias("type"), F.col("title"), *rest), {"ignoreNullFields": "false"})
        elif kind == "graphml":
            head = [F.lit('<node id="'), _xml(key), F.lit(f'"><data key="type">{escape(t)}</data><data key="title">'), _xml(title), F.lit("</data>")]
            line = F.concat(*head, _data(df, rest, "data", "key", ">"), F.lit("</node>"))
        else:
            head = [F.lit('<node id="'), _xml(key), F.lit('" label="'), _xml(title), F.lit(f'"><attvalues><attvalue for="type" value={quoteattr(t)}/>')]
            line = F.concat(*head, _data(df, rest, "attvalue", "for", ' value="'), F.lit("</attvalues></node>"))
        out.append(df.select(F.lit(1).alias("part"), key.alias("key"), line.alias("line")))
    for name, t in g.edge_pairs():
        src, dst = _key(t.src_type, "src"), _key(t.dst_type, "dst")
        if kind == "d3":
            line = F.to_json(F.struct(src.alias("source"), dst.alias("target"), F.lit(name).alias("type"), *t.properties), {"ignoreNullFields": "false"})
        elif kind == "graphml":
            head = [F.lit('<edge source="'), _xml(src), F.lit('" target="'), _xml(dst), F.lit(f'"><data key="type">{escape(name)}</data>')]
            line = F.concat(*head, _data(t.df, t.properties, "data", "key", ">"), F.lit("</edge>"))
        else:
            head = [F.lit('<edge source="'), _xml(src), F.lit('" target="'), _xml(dst), F.lit(f'" label={quoteattr(name)}><attvalues>')]
            line = F.concat(*head, _data(t.df, t.properties, "attvalue", "for", ' value="'), F.lit("</attvalues></edge>"))
        out.append(t.df.select(F.lit(2).alias("part"), F.concat_ws(" ", F.lit(name), src, dst).alias("key"), line.alias("line")))
    lines = out[0]
    for x in out[1:]:
        lines = lines.union(x)
    return lines


def _frame(g: PropertyGraph, kind: str) -> tuple[str, str, str]:
    """What stands before the nodes, between nodes and relationships, and after these."""
    if kind == "d3":
        return '{"nodes": [', '], "links": [', "]}"
    of_nodes = sorted({c for t in g.node_types for c in g.nodes[t].columns} - {"id", "title"})
    of_edges = sorted({c for _, t in g.edge_pairs() for c in t.properties})
    if kind == "graphml":
        keys = [f"<key id={quoteattr(c)} for={quoteattr(x)} attr.name={quoteattr(c)} attr.type=\"string\"/>" for c, x in [("type", "all"), ("title", "node"), *((c, "all" if c in of_edges else "node") for c in of_nodes), *((c, "edge") for c in of_edges if c not in of_nodes)]]
        return '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(keys) + '\n<graph edgedefault="directed">', "", "</graph>\n</graphml>"
    if kind == "gexf":
        named = [f'<attributes class="{x}">' + "".join(f'<attribute id={quoteattr(c)} title={quoteattr(c)} type="string"/>' for c in names) + "</attributes>" for x, names in (("node", ["type", *of_nodes]), ("edge", of_edges))]
        return '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">\n' + "\n".join(named) + "\n<nodes>", "</nodes><edges>", "</edges></graph></gexf>"
    raise ValueError(f"unknown format {kind}")


def exported(g: PropertyGraph, spark: SparkSession, kind: str) -> DataFrame:
    """The lines of a graphml, gexf or d3 document in order: a range sort, so any number of tasks writes it."""
    first, between, last = _frame(g, kind)
    ends = spark.createDataFrame([(0, "", first), (1, None, None), (2, "", between), (3, "", last)], "part int, key string, line string").where("line is not null")
    lines = _lines(g, kind)
    if kind == "d3":
        # all lines but the first of each list begin with a comma
        lines = cut(lines.withColumn("n", F.monotonically_increasing_id()))
        least = lines.groupBy("part").agg(F.min(F.struct("key", "n")).alias("least"))
        lines = lines.join(F.broadcast(least), "part").select("part", "key", F.concat(F.when(F.struct("key", "n") == F.col("least"), "").otherwise(","), "line").alias("line"))
    # the line between the lists comes before all relationships, whose keys are never empty
    return ends.union(lines).where("line <> ''").orderBy("part", "key").select("line")


def export(g: PropertyGraph, spark: SparkSession, path: str, kind: str) -> None:
    """A folder of text parts that make up a graphml, gexf or d3 document if put together in the order of their names."""
    exported(g, spark, kind).write.mode("overwrite").text(path)


def export_string(g: PropertyGraph, spark: SparkSession, kind: str) -> str:
    """The whole document; for graphs that fit on the driver."""
    return "\n".join(r.line for r in exported(g, spark, kind).toLocalIterator())


def export_embeddings(g: PropertyGraph, path: str) -> None:
    """A folder of Parquet tables (id, vector), one per node type and property."""
    for (t, p), df in g.embeddings.items():
        df.write.mode("overwrite").parquet(f"{path}/type={t}/property={p}")


def import_embeddings(g: PropertyGraph, spark: SparkSession, path: str) -> PropertyGraph:
    """The graph with the exported vectors of types that it has; vectors of unknown nodes are left out."""
    found = spark.read.parquet(path)
    for t, p in sorted(tuple(r) for r in found.select("type", "property").distinct().collect()):
        if t in g.nodes:
            one = found.where((F.col("type") == t) & (F.col("property") == p)).withColumn("id", F.col("id").cast(dict(g.nodes[t].dtypes)["id"]))
            g = g.set_embeddings(t, p, one.join(g.nodes[t].select("id"), "id", "left_semi"))
    return g


def list_embeddings(g: PropertyGraph) -> DataFrame | None:
    """(type, property, vectors, dimension, missing): nodes without a vector count as missing."""
    out = None
    for (t, p), df in g.embeddings.items():
        one = df.agg(F.count("vector").alias("vectors"), F.max(F.size("vector")).alias("dimension"))
        lack = g.nodes[t].join(df.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))
        one = one.join(lack).select(F.lit(t).alias("type"), F.lit(p).alias("property"), "vectors", "dimension", "missing")
        out = one if out is None else out.union(one)
    return out
