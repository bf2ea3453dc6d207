import json

import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions import spatial
from weftgraph.operators import inspect
from weftgraph.sources import snapshot
from weftgraph.sources.blueprint import from_blueprint
from weftgraph.sources.ntriples import load_ntriples
from weftgraph.streaming.ingest import upsert_stream


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([(1, "A & <B>", 2.0), (2, None, None)], "id long, name string, x double")
    e = spark.createDataFrame([(1, 2, 7)], "a long, b long, w long")
    return PropertyGraph().add_nodes(n, "N", "id", "name").add_edges(e, "E", "N", "a", "N", "b").set_temporal("N", "x", "x")


def test_snapshot_round_trip(spark, g, tmp_path):
    snapshot.save(g, spark, str(tmp_path / "g"))
    h = snapshot.load(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, h.nodes["N"].collect()), key=str) == sorted(map(tuple, g.nodes["N"].collect()), key=str)
    assert [tuple(r) for r in h.edge_table("E").collect()] == [tuple(r) for r in g.edge_table("E").collect()]
    assert h.info["N"].temporal == ("x", "x")


def whole(path):
    return "\n".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_exports(spark, g, tmp_path):
    import xml.etree.ElementTree as ET

    snapshot.export(g, spark, str(tmp_path / "d3"), "d3")
    d = json.loads(whole(tmp_path / "d3"))
    assert [(n["id"], n["title"], n["x"]) for n in d["nodes"]] == [("N:1", "A & <B>", 2.0), ("N:2", None, None)]
    assert d["links"] == [{"source": "N:1", "target": "N:2", "type": "E", "w": 7}]
    assert json.loads(snapshot.export_string(g, spark, "d3")) == d
    snapshot.export(g, spark, str(tmp_path / "graphml"), "graphml")
    root = ET.fromstring(whole(tmp_path / "graphml").split("\n", 1)[1])
    name = "{http://graphml.graphdrawing.org/xmlns}"
    data = {n.get("id"): {x.get("key"): x.text for x in n} for n in root.iter(f"{name}node")}
    assert data == {"N:1": {"type": "N", "title": "A & <B>", "x": "2.0"}, "N:2": {"type": "N", "title": None}}
    assert [{x.get("key"): x.text for x in e} for e in root.iter(f"{name}edge")] == [{"type": "E", "w": "7"}]
    assert {k.get("id") for k in root.iter(f"{name}key")} == {"type", "title", "x", "w"}
    snapshot.export(g, spark, str(tmp_path / "gexf"), "gexf")
    root = ET.fromstring(whole(tmp_path / "gexf").split("\n", 1)[1])
    name = "{http://gexf.net/1.3}"
    values = {n.get("id"): {x.get("for"): x.get("value") for x in n.iter(f"{name}attvalue")} for n in root.iter(f"{name}node")}
    assert values == {"N:1": {"type": "N", "x": "2.0"}, "N:2": {"type": "N"}}
    assert [{x.get("for"): x.get("value") for x in e.iter(f"{name}attvalue")} for e in root.iter(f"{name}edge")] == [{"w": "7"}]
    snapshot.export_csv(g, str(tmp_path / "csv"))
    assert (tmp_path / "csv/nodes/N/_SUCCESS").exists()
    lone = PropertyGraph(nodes={"N": g.nodes["N"]})
    assert json.loads(snapshot.export_string(lone, spark, "d3"))["links"] == []


def test_embeddings_round_trip(spark, g, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (9, [0.0, 1.0])], "id long, vector array<float>")
    snapshot.export_embeddings(g.set_embeddings("N", "text", v), str(tmp_path / "e"))
    h = snapshot.import_embeddings(g, spark, str(tmp_path / "e"))
    assert [tuple(r) for r in snapshot.list_embeddings(h).collect()] == [("N", "text", 1, 2, 1)]
    assert snapshot.list_embeddings(g) is None


def test_ntriples(spark, tmp_path):
    lines = [
        '<http://x/e/Q1> <http://x/p/type> <http://x/e/City> .',
        '<http://x/e/Q1> <http://x/p/label> "Oslo \\"city\\""@en .',
        '<http://x/e/Q1> <http://x/p/label> "Oslo by"@no .',
        '<http://x/e/Q1> <http://x/p/size> "700"^^<http://x/int> .',
        '<http://x/e/Q1> <http://x/p/in> <http://x/e/Q2> .',
        '<http://x/e/Q2> <http://x/p/label> "Norway"@en .',
        "# a comment",
        "broken line",
    ]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    g = load_ntriples(spark, str(tmp_path / "a.nt"), properties=["size"], links=["in"])
    assert tuple(g.nodes["City"].first()) == ("Q1", 'Oslo "city"', "700")
    assert [tuple(r) for r in g.edge_table("in").select("src_type", "src", "dst_type", "dst").collect()] == [("City", "Q1", "Entity", "Q2")]


def test_ntriples_escapes_and_blank_nodes(spark, tmp_path):
    lines = [
        r'<http://x/a> <http://x/p/label> "C:\\new\tline\n \"q\" \u00e9 \uD83D\uDE00 \U0001F600" .',
        '_:b1 <http://x/p/label> "blank" . # why not',
        "<http://x/a> <http://x/p/in> _:b1 .",
        '<http://y/a> <http://x/p/label> "other" .',
    ]
    (tmp_path / "b.nt").write_text("\n".join(lines))
    g = load_ntriples(spark, str(tmp_path / "b.nt"), links=["in"], whole=True)
    assert {r.id: r.title for r in g.nodes["Entity"].collect()} == {"http://x/a": 'C:\\new\tline\n "q" é 😀 😀', "_:b1": "blank", "http://y/a": "other"}
    assert [tuple(r) for r in g.edge_table("in").select("src", "dst").collect()] == [("http://x/a", "_:b1")]
    assert load_ntriples(spark, str(tmp_path / "b.nt")).nodes["Entity"].count() == 2


def test_blueprint(spark, tmp_path):
    (tmp_path / "field.csv").write_text("fid,name,owner,status\n1,Troll,10,on\n2,Ekofisk,11,off\n")
    (tmp_path / "company.csv").write_text("cid,name\n10,Alpha\n11,Beta\n")
    (tmp_path / "partner.csv").write_text("fid,cid,share\n1,11,40.5\n9,10,1\n")
    spec = {
        "nodes": {"Field": {"csv": "field.csv", "id": "fid", "title": "name", "types": {"fid": "bigint", "owner": "bigint"}, "fk_edges": {"OWNED_BY": {"to": "Company", "column": "owner"}}}, "Company": {"csv": "company.csv", "id": "cid", "title": "name", "types": {"cid": "bigint"}}},
        "junctions": [{"csv": "partner.csv", "edge": "PARTNER", "from": "Field", "from_column": "fid", "to": "Company", "to_column": "cid", "types": {"fid": "bigint", "cid": "bigint", "share": "double"}}],
    }
    g = from_blueprint(spark, str(tmp_path), json.dumps(spec))
    assert g.edge_table("OWNED_BY").count() == 2
    assert [tuple(r) for r in g.edge_table("PARTNER").select("src", "dst", "share").collect()] == [(1, 11, 40.5)]


def test_inspection(g):
    assert [tuple(r) for r in inspect.connectivity(g).collect()] == [("N", "E", "N", 1)]
    assert "N(id: bigint, title: string, x: double)" in inspect.schema_text(g)
    assert "<connection" in inspect.describe(g)
    assert {r.property: r.filled for r in inspect.properties(g, "N").collect()} == {"id": 2, "title": 1, "x": 1}


def test_stream_upserts(spark, tmp_path):
    for i, rows in enumerate(([(1, "a")], [(1, "b"), (2, "c")])):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = upsert_stream(spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/v={i}")).collect())
        assert got == ([(1, "a")] if i == 0 else [(1, "b"), (2, "c")])


def test_geodesy(spark):
    oslo, bergen = (59.9139, 10.7522), (60.3913, 5.3221)
    d = spark.range(1).select(spatial.distance(*[F.lit(x) for x in (*oslo, *bergen)])).first()[0]
    assert d == pytest.approx(305_480, rel=0.005)
    square = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    r = spark.range(1).select(spatial.area(F.lit(square)).alias("a"), spatial.perimeter(F.lit(square)).alias("p"), spatial.centroid(F.lit(square)).alias("c"), spatial.contains_point(F.lit(square), F.lit(0.5), F.lit(0.5)).alias("i"), spatial.contains_point(F.lit(square), F.lit(0.0), F.lit(0.5)).alias("b"), spatial.is_valid(F.lit("POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))")).alias("v"), spatial.intersects(F.lit(square), F.lit("LINESTRING (-1 0.5, 2 0.5)")).alias("x"), spatial.area(spatial.intersection(F.lit(square), F.lit("POLYGON ((0.5 0, 2 0, 2 1, 0.5 1, 0.5 0))"))).alias("h")).first()
    assert r.a == pytest.approx(1.2309e10, rel=0.002) and r.p == pytest.approx(443_770, rel=0.002)
    assert (r.c.lat, r.c.lon, r.i, r.b, r.v, r.x) == (0.5, 0.5, True, False, False, True)
    assert r.h == pytest.approx(r.a / 2, rel=1e-3)


def test_distance_join_equals_brute_force(spark):
    import random

    random.seed(3)
    a = [(i, random.uniform(-89, 89), random.uniform(-180, 180)) for i in range(150)]
    b = [(i, random.uniform(-89, 89), random.uniform(-180, 180)) for i in range(150)] + [(200, 10.0, 179.99), (201, 88.0, 0.0)]
    a += [(200, 10.0, -179.99), (201, 88.0, 179.0)]
    A, B = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (a, b))
    got = sorted((r.a_id, r.b_id) for r in spatial.distance_join(A, B, 600_000).collect())
    import numpy as np

    want = []
    for i, la, lo in a:
        d = spatial.geodesic(np.full(len(b), la), np.full(len(b), lo), [x[1] for x in b], [x[2] for x in b])
        want += [(i, x[0]) for x, m in zip(b, d, strict=True) if m <= 600_000]
    assert got == sorted(want)
