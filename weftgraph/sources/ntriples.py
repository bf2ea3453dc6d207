"""N-Triples: literals become properties, links to other subjects relationships."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import EdgeTable, PropertyGraph, TypeInfo

_NODE = r"<([^>]*)>|(_:[^\s<>\".]+(?:\.+[^\s<>\".]+)*)"
_TRIPLE = rf'^\s*(?:{_NODE})\s+<([^>]*)>\s+(?:{_NODE}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
#: Pieces of an escaped text from left to right: runs of 16-bit units (pairs belong together), one long unit, one escape, plain text.
_PIECE = r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescape(c: Column) -> Column:
    """Escapes become what they stand for, in one pass from left to right."""

    def piece(x: Column) -> Column:
        kind = F.substring(x, 2, 1)
        units = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long_unit = F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32")
        named = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in _ESCAPES.items() for y in kv]), kind), kind)
        return F.when(~x.startswith("\\"), x).when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), units).when(x.rlike(r"^\\U[0-9A-Fa-f]{8}$"), long_unit).otherwise(named)

    parts = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(parts, piece), "")).otherwise(c)


def _local(c: Column) -> Column:
    """What follows the last slash or hash of an address; blank nodes keep their label."""
    return F.when(c.startswith("_:"), c).otherwise(F.regexp_extract(c, r"([^/#]*)$", 1))


def triples(spark: SparkSession, path: str, languages: Sequence[str] = ("en",), whole: bool = False) -> DataFrame:
    """(s, p, link, value): compressed files are read by their ending; literals in other languages are left out.

    Addresses are named by their last part, or, with whole, in full; blank nodes are _:label.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    named = lambda i: F.nullif(F.concat(unescape(part(i)), part(i + 1)), F.lit(""))
    rows = lines.where(F.col("value").rlike(_TRIPLE)).select(named(1).alias("s"), unescape(part(3)).alias("p"), named(4).alias("link"), unescape(part(6)).alias("value"), part(7).alias("lang"))
    name = (lambda c: F.col(c)) if whole else (lambda c: _local(F.col(c)))
    rows = rows.where((F.col("lang") == "") | F.lower("lang").isin(*[x.lower() for x in languages]))
    return rows.select(name("s").alias("s"), _local(F.col("p")).alias("p"), name("link").alias("link"), F.when(F.col("link").isNull(), F.col("value")).alias("value"))


def load_ntriples(spark: SparkSession, path: str, type_predicate: str = "type", title_predicate: str = "label", properties: Sequence[str] = (), links: Sequence[str] = (), languages: Sequence[str] = ("en",), names: Mapping[str, str] | None = None, whole: bool = False) -> PropertyGraph:
    """One pass for nodes (a groupBy on the subject, the first value of each property) and one per link predicate.

    Subjects without a type are of type Entity. names renames types. Predicates are named by their last part, and so are
    subjects unless whole asks for full addresses, as it must where addresses of different places end alike.
    """
    t = triples(spark, path, languages, whole)
    names = names or {}
    kind = F.first(F.when(F.col("p") == type_predicate, _local(F.coalesce("link", "value"))), ignorenulls=True)
    title = F.first(F.when(F.col("p") == title_predicate, F.col("value")), ignorenulls=True)
    values = [F.first(F.when(F.col("p") == p, F.col("value")), ignorenulls=True).alias(p) for p in properties]
    nodes = t.groupBy(F.col("s").alias("id")).agg(F.coalesce(kind, F.lit("Entity")).alias("_type"), title.alias("title"), *values)
    for old, new in names.items():
        nodes = nodes.withColumn("_type", F.when(F.col("_type") == old, new).otherwise(F.col("_type")))
    kinds = sorted(r[0] for r in nodes.select("_type").distinct().collect())
    tables = {k: nodes.where(F.col("_type") == k).drop("_type") for k in kinds}
    typed = nodes.select("id", "_type")
    edges: dict[str, tuple[EdgeTable, ...]] = {}
    for p in links:
        e = t.where((F.col("p") == p) & F.col("link").isNotNull()).select(F.col("s").alias("src"), F.col("link").alias("dst"))
        e = e.join(typed.select(F.col("id").alias("src"), F.col("_type").alias("_a")), "src").join(typed.select(F.col("id").alias("dst"), F.col("_type").alias("_b")), "dst")
        pairs = sorted(tuple(r) for r in e.select("_a", "_b").distinct().collect())
        edges[p] = tuple(EdgeTable(a, b, e.where((F.col("_a") == a) & (F.col("_b") == b)).select("src", "dst")) for a, b in pairs)
    return PropertyGraph(nodes=tables, edges=edges, info={k: TypeInfo() for k in kinds})
