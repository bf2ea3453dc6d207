"""Blueprints: a description in JSON of CSV files and the graph they make."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions import series


def _read(spark: SparkSession, root: str, spec: dict[str, Any]) -> DataFrame:
    df = spark.read.option("header", True).csv(f"{root}/{spec['csv']}")
    for name, kind in spec.get("types", {}).items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    for name, wanted in spec.get("filter", {}).items():
        df = df.where(F.col(name).isin(*wanted) if isinstance(wanted, list) else F.col(name) == wanted)
    return df


def from_blueprint(spark: SparkSession, root: str, blueprint: dict[str, Any] | str) -> PropertyGraph:
    """blueprint: {"nodes": {type: {csv, id, title, types, filter, skip, fk_edges, timeseries, location}}, "junctions": [...]}.

    fk_edges: {edge: {"to": type, "column": c}} reads relationships from a node file's own columns; junctions:
    {csv, edge, from, from_column, to, to_column} from files of pairs.
    """
    spec = json.loads(blueprint) if isinstance(blueprint, str) else blueprint
    g = PropertyGraph()
    files = {t: _read(spark, root, s) for t, s in spec["nodes"].items()}
    for t, s in spec["nodes"].items():
        g = g.add_nodes(files[t], t, s["id"], s.get("title"), skip_columns=s.get("skip", ()))
        if place := s.get("location"):
            g = g.set_spatial(t, place["lat"], place["lon"])
        if ts := s.get("timeseries"):
            g = g.set_series(t, series.collect(files[t], s["id"], ts["date"], ts["channels"], ts.get("resolution", "day")))
    for t, s in spec["nodes"].items():
        for edge, fk in s.get("fk_edges", {}).items():
            g = g.add_edges(files[t].select(s["id"], fk["column"]) if s["id"] != fk["column"] else files[t].select(s["id"]), edge, t, s["id"], fk["to"], fk["column"], columns=[])
    for j in spec.get("junctions", ()):
        g = g.add_edges(_read(spark, root, j), j["edge"], j["from"], j["from_column"], j["to"], j["to_column"])
    return g
