import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions import dates, predicates, scalars, series, vectors
from weftgraph.operators import algorithms, integrity, mutate, paths, rows, traversal
from weftgraph.plans.pattern import Ref, count_pattern, exists, match, node, optional_match


@pytest.fixture(scope="module")
def g(spark):
    people = spark.createDataFrame([(1, "Alice", 28, "Oslo"), (2, "Bob", 35, "Bergen"), (3, "Charlie", 42, "Oslo"), (4, "Diana", None, None)], "person_id long, name string, age long, city string")
    knows = spark.createDataFrame([(1, 2, 2020), (2, 3, 2019), (1, 3, 2021), (3, 99, 2000), (None, 1, 1)], "a long, b long, since long")
    things = spark.createDataFrame([(101, "Pen", 2.5), (102, "Cup", 10.0)], "product_id long, name string, price double")
    bought = spark.createDataFrame([(1, 101), (1, 102), (2, 101), (2, 101)], "a long, b long")
    out = PropertyGraph().add_nodes(people, "Person", "person_id", "name").add_nodes(things, "Product", "product_id", "name")
    return out.add_edges(knows, "KNOWS", "Person", "a", "Person", "b").add_edges(bought, "BOUGHT", "Person", "a", "Product", "b")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_endpoints_are_checked_and_parallel_edges_stay(g):
    assert g.edge_table("KNOWS").count() == 3
    assert g.edge_table("BOUGHT").count() == 4


def test_hops_and_directions(g):
    one = match(g, node("a", "Person", name="Alice").out("KNOWS", "b", "Person")).select("b.title")
    assert rows_of(one) == [("Bob",), ("Charlie",)]
    assert rows_of(match(g, node("a", "Person", name="Charlie").into("KNOWS", "b")).select("b.title")) == [("Alice",), ("Bob",)]
    assert match(g, node("a", "Person", name="Bob").both("KNOWS", "b", "Person")).count() == 2
    two = match(g, node("a", "Person").out("KNOWS", "b", "Person").out("KNOWS", "c", "Person")).select("a.id", "c.id")
    assert rows_of(two) == [(1, 3)]


def test_unknown_property_in_pattern_is_an_error(g):
    with pytest.raises(ValueError):
        match(g, node("a", "Person", shoe_size=44))


def test_repeated_variable_closes_a_triangle(g):
    t = match(g, node("a", "Person").out("KNOWS", "b", "Person"), node("b", "Person").out("KNOWS", "c", "Person"), node("a", "Person").out("KNOWS", "c", "Person"))
    assert rows_of(t.select("a.id", "b.id", "c.id")) == [(1, 2, 3)]


def test_optional_exists_and_count(g):
    p = match(g, node("a", "Person"))
    o = optional_match(g, p, node("a", "Person").out("BOUGHT", "x", "Product"))
    assert rows_of(o.groupBy("a.id").agg(F.count("x.id").alias("n"))) == [(1, 2), (2, 2), (3, 0), (4, 0)]
    assert rows_of(exists(g, p, node("a", "Person").out("BOUGHT", "x", "Product"), "x.price > 5").select("a.id")) == [(1,)]
    assert rows_of(exists(g, p, node("a", "Person").out("BOUGHT", "x", "Product"), negate=True).select("a.id")) == [(3,), (4,)]
    assert rows_of(count_pattern(g, p, node("a", "Person").out("KNOWS", "b", "Person"), "n").select("a.id", "n")) == [(1, 2), (2, 1), (3, 0), (4, 0)]


def test_walks_keep_a_target_once_per_depth(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "a long, b long")
    g = PropertyGraph().add_nodes(nodes, "N", "id").add_edges(e, "E", "N", "a", "N", "b")
    m = match(g, node("s", "N", id=0).out("E", "t", "N", hops=(1, None), var="depth"))
    assert rows_of(m.select("t.id", "depth")) == [(1, 1), (2, 1), (3, 2)]


def test_untyped_scan_and_builtin_names(g):
    assert rows_of(match(g, node("n")).groupBy("n.type").count()) == [("Person", 4), ("Product", 2)]
    assert rows_of(match(g, node("n", "Person", person_id=2)).select("n.title")) == [("Bob",)]


def test_two_valued_logic(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    x = F.col("x")
    got = df.select(predicates.not_(x < 1), predicates.ne(x, 1), predicates.eq(x, None), predicates.is_in(x, [1, None]), predicates.xor(x == 1, F.lit(True))).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True, False), (True, True, False, False, True)]


def test_absent_fields_match_only_is_null(g):
    n = g.nodes["Person"]
    assert n.where(predicates.condition(n, "nothing", {"!=": 3})).count() == 0
    assert n.where(predicates.condition(n, "nothing", None)).count() == 4
    assert n.where(predicates.condition(n, "city", {"not_contains": "Oslo"})).count() == 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("  Héllo, World ", 7, -3), (None, None, 2)], "s string, a int, b int")
    s = F.col("s")
    one, two = df.select(scalars.trim(s), scalars.size_of_text(s), scalars.normalize(s), scalars.substring(s, 2, 3), scalars.divide(F.col("a"), F.lit(0)), scalars.divide(F.col("a"), F.col("b"), whole=True), scalars.to_integer(F.lit("1.5")), scalars.sqrt(F.col("b").cast("double"))).collect()
    assert tuple(one) == ("Héllo, World", 16, "héllo world", "Hél", None, -2, None, None)
    assert two[0] is None and two[7] == pytest.approx(2**0.5)
    lists = spark.range(1).select(scalars.slice_(F.array(*map(F.lit, range(5))), 1, -1).alias("a"), scalars.at(F.array(F.lit(1)), 3).alias("b"), scalars.range_(F.lit(3), F.lit(1)).alias("c"), scalars.range_(F.lit(3), F.lit(1), -1).alias("d"), scalars.token_jaccard(F.lit("a b"), F.lit("b c")).alias("e"), scalars.single(F.array(F.lit(1), F.lit(2)), lambda x: x > 1).alias("f")).first()
    assert (list(lists.a), lists.b, list(lists.c), list(lists.d), round(lists.e, 4), lists.f) == ([1, 2, 3], None, [], [3, 2, 1], 0.3333, True)


def test_dates(spark):
    df = spark.createDataFrame([("2020",), ("2020-2",), ("2020-02-30",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(dates.date(F.col("s"))).collect()] == [dt.date(2020, 1, 1), dt.date(2020, 2, 1), None, None, None]
    r = spark.range(1).select(dates.between(dates.date(F.lit("2020")), dates.date(F.lit("2020-01-11")))["days"].alias("d"), dates.day_of_week(dates.datetime(F.lit("2024-01-01T10:00"))).alias("w")).first()
    assert (r.d, r.w) == (10, 1)


def test_order_puts_nulls_by_direction(g):
    ages = g.nodes["Person"].select("age")
    assert [r[0] for r in rows.top(ages, 4, "age").collect()] == [28, 35, 42, None]
    assert [r[0] for r in rows.top(ages, 4, ("age", "desc")).collect()] == [None, 42, 35, 28]


def test_aggregates_of_nothing(spark):
    r = spark.createDataFrame([], "x long").agg(rows.total(F.col("x")).alias("s"), F.avg("x").alias("a"), rows.std(F.col("x")).alias("d"), rows.collect(F.col("x")).alias("c")).first()
    assert (r.s, r.a, r.d, list(r.c)) == (0, None, None, [])


def test_upsert_modes(spark, g):
    new = spark.createDataFrame([(1, "Alicia", None), (9, "Zoe", 5)], "person_id long, name string, age long")
    for mode, alice in (("update", ("Alicia", 28)), ("replace", ("Alicia", None)), ("skip", ("Alice", 28)), ("preserve", ("Alice", 28))):
        n = g.add_nodes(new, "Person", "person_id", "name", mode=mode).nodes["Person"]
        assert n.count() == 5
        assert tuple(n.where("id = 1").select("title", "age").first()) == alice
    e = g.add_edges(spark.createDataFrame([(1, 2, 5)], "a long, b long, since long"), "KNOWS", "Person", "a", "Person", "b", mode="sum")
    assert e.edge_table("KNOWS").where("src = 1 and dst = 2").first().since == 2025


def test_traversal_and_sets(g):
    s = traversal.select(g, "Person")
    assert rows_of(s.where({"city": "Oslo"}).traverse("KNOWS", "out").ids()) == [(2,), (3,)]
    assert rows_of(s.where_orphans().ids()) == [(4,)]
    a, b = s.where({"id": [1, 2]}), s.where({"id": [2, 3]})
    assert [rows_of(x.ids()) for x in (a.union(b), a.intersection(b), a.difference(b), a.symmetric_difference(b))] == [[(1,), (2,), (3,)], [(2,)], [(1,)], [(1,), (3,)]]
    assert rows_of(s.traverse("KNOWS", "out").statistics("age").select("l0", "count", "sum")) == [(1, 2, 77), (2, 1, 42)]
    assert rows_of(a.difference(b).expand(1)) == [("Person", "1"), ("Person", "2"), ("Person", "3"), ("Product", "101"), ("Product", "102")]
    assert s.update({"age": 1}).nodes["Person"].where("age = 1").count() == 4
    sub = traversal.subgraph(g, {"Person": a.ids()})
    assert sub.edge_table("KNOWS").count() == 1


def test_rules(g):
    assert rows_of(integrity.orphan_nodes(g, "Person").select("id")) == [(4,)]
    assert rows_of(integrity.missing_inbound_edge(g, "Person", "KNOWS").select("id")) == [(1,), (4,)]
    assert rows_of(integrity.parallel_edges(g, "BOUGHT").select("src", "dst", "edge_count")) == [(2, 101, 2)]
    assert integrity.transitivity_violations(g, "KNOWS").count() == 0
    assert integrity.inverse_violations(g, "KNOWS", "KNOWS").count() == 3
    assert rows_of(integrity.cardinality_violations(g, "Person", "KNOWS", 1, 1).select("id", "edge_count")) == [(1, 2), (3, 0), (4, 0)]


def test_changes_leave_the_old_graph_alone(spark, g):
    with pytest.raises(ValueError):
        mutate.delete_nodes(g, "Person", g.nodes["Person"].where("id = 1"))
    after = mutate.delete_nodes(g, "Person", g.nodes["Person"].where("id = 1"), detach=True)
    assert (after.nodes["Person"].count(), after.edge_table("KNOWS").count(), g.nodes["Person"].count()) == (3, 1, 4)
    created = mutate.create_nodes(g, "Person", spark.createDataFrame([("Eve", 1), ("Fay", 2)], "title string, age long"), "title")
    assert rows_of(created.nodes["Person"].where("id > 4").select("id", "title")) == [(5, "Eve"), (6, "Fay")]
    store = mutate.Store(g)
    a, b = store.begin(), store.begin()
    a.apply(mutate.set_properties, "Person", {"age": 0})
    a.commit()
    b.apply(mutate.set_properties, "Person", {"age": 1})
    with pytest.raises(RuntimeError):
        b.commit()
    with pytest.raises(PermissionError):
        store.begin(read_only=True).apply(mutate.set_properties, "Person", {"age": 1})


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, None), (8, 9, 1.0)], "src long, dst long, w double")
    pairs = spark.createDataFrame([(1, 4), (1, 9), (2, 2)], "source long, target long")
    got = paths.shortest_paths(e, pairs).collect()
    assert [(r.source, r.target, r.hops, list(r.path)) for r in got] == [(1, 4, 2, [1, 3, 4])]
    start = spark.createDataFrame([(1,)], "source long")
    assert rows_of(paths.cheapest(e, start, "w", directed=True).select("node", "cost")) == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    assert sorted(list(r.path) for r in paths.all_paths(e, 1, 4).collect()) == [[1, 2, 3, 4], [1, 3, 4]]


def test_algorithms(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    comp = {r.node: r.component for r in algorithms.connected_components(nodes, e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    strong = {r.node: r.component for r in algorithms.strong_components(nodes, e).collect()}
    assert strong == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    score = {r.node: r.score for r in algorithms.pagerank(nodes, e).collect()}
    want = {i: 1 / 7 for i in range(1, 8)}
    out = {1: [2], 2: [3], 3: [1, 4], 5: [6]}
    for _ in range(100):
        lost = sum(v for k, v in want.items() if k not in out)
        new = {k: 0.15 / 7 + 0.85 * lost / 7 for k in want}
        for k, ends in out.items():
            for x in ends:
                new[x] += 0.85 * want[k] / len(ends)
        want = new
    assert all(abs(score[k] - want[k]) < 1e-5 for k in want)
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    four = nodes.where("id < 5")
    assert {r.node: r.score for r in algorithms.betweenness(four, path, normalized=False).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}
    assert {r.node: round(r.score, 4) for r in algorithms.closeness(four, path).collect()} == {1: 0.0, 2: 0.3333, 3: 0.4444, 4: 0.5}
    two = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "src long, dst long")
    found = {r.node: r.community for r in algorithms.louvain(nodes.where("id < 7"), two).collect()}
    assert found[1] == found[2] == found[3] != found[4] == found[5] == found[6]


def test_louvain_puts_settled_components_aside(spark, monkeypatch):
    sizes, stored = [], algorithms.stored

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(algorithms, "stored", counted)
    stars = [(h * 10, h * 10 + i) for h in range(1, 21) for i in range(1, 6)]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in stars for x in e} | {7})], "id long")
    found = {r.node: r.community for r in algorithms.louvain(nodes, spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert len(found) == 121 and found[7] == 7
    assert all(found[h] == found[leaf] for h, leaf in stars) and len(set(found.values())) == 21
    assert sizes[-1] < sizes[0] == 120


def test_clustering(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 0.0, 0.1), (4, 5.0, 5.0), (5, 5.1, 5.0), (6, 5.0, 5.1), (7, 50.0, 0.0)], "id long, x double, y double")
    assert rows_of(algorithms.dbscan(p, ["x", "y"], 0.5, 2)) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, -1)]
    k = {r.id: r.cluster for r in algorithms.kmeans(p, ["x", "y"], 3).collect()}
    assert len({k[1], k[4], k[7]}) == 3 and k[1] == k[2] == k[3] and k[4] == k[5] == k[6]


def test_series(spark):
    troll = [("2019-12", 0.9), ("2020-01", 1.0), ("2020-02", 1.5), ("2020-03", 2.0), ("2021-01", 3.0)]
    s = spark.createDataFrame([(1, series.span(d)[0], "oil", v) for d, v in troll] + [(1, dt.date(2020, 4, 1), "oil", float("nan"))], "id long, date date, channel string, value double")
    one = lambda df: df.first()[1]
    assert one(series.aggregate(s, "oil", "sum", "2020")) == 4.5
    assert one(series.aggregate(s, "oil", "count", "2020-2", "2021")) == 3
    assert one(series.at(s, "oil", "2020-3")) == 2.0
    assert one(series.delta(s, "oil", "2019", "2021")) == pytest.approx(2.1)
    assert [p.value for p in one(series.listed(s, "oil", 2020))] == [1.0, 1.5, 2.0]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, None)], "id long, vector array<double>")
    assert [r.id for r in vectors.search(v, "vector", [1, 0, 0], 2).collect()] == [1, 3]
    with pytest.raises(Exception, match="different lengths"):
        vectors.search(v, "vector", [1, 0], 2).collect()


def test_validity(spark):
    f = spark.createDataFrame([(1, "2000-01-01", "2010-12-31"), (2, "1990-01-01", None), (3, "2011-01-01", "2099-01-01")], "id long, a string, b string").select("id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    g = PropertyGraph().add_nodes(f, "Licence", "id").set_temporal("Licence", "a", "b")
    day = lambda x: F.lit(x).cast("date")
    assert rows_of(traversal.select(g, "Licence").valid_at(day("2005-06-01")).ids()) == [(1,), (2,)]
    assert rows_of(traversal.select(g, "Licence").valid_during(day("2010-06-01"), day("2012-01-01")).ids()) == [(1,), (2,), (3,)]


def test_text_embeddings(spark):
    class Letters:
        """A stand-in embedder: how often a and b occur."""

        dimension = 2

        def load(self):
            self.ready = True

        def embed(self, texts):
            assert self.ready
            return [(t.count("a"), t.count("b")) for t in texts]

        def unload(self):
            self.ready = False

    docs = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, None)], "id long, t string")
    v = vectors.embed_texts(docs, "t", Letters())
    assert {r.id: r.vector for r in v.collect()} == {1: [3.0, 0.0], 2: [0.0, 3.0], 3: None}
    assert [r.id for r in vectors.text_search(v, "vector", "a", Letters(), 1).collect()] == [1]


def test_aggregates_go_up(g):
    up = traversal.select(g, "Person").traverse("BOUGHT", "out").aggregate_up(0, {"n": "count(*)", "spent": "sum(price)"})
    assert rows_of(up.nodes["Person"].select("id", "n", "spent").where("n is not null")) == [(1, 2, 12.5), (2, 1, 2.5)]


def test_foreign_keys_join_like_relationships(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    b = spark.createDataFrame([(10, 1), (11, 1), (12, None), (13, 9)], "id long, a_id long")
    plain = PropertyGraph().add_nodes(a, "A", "id", "name").add_nodes(b, "B", "id")
    e = b.select("id", "a_id")
    graphs = [plain.add_edges(e, "HAS", "A", "a_id", "B", "id", columns=[], key=k) for k in (None, ("dst", "a_id"))]
    for p in (node("a", "A").out("HAS", "b", "B"), node("b", "B").into("HAS", "a", "A"), node("b", "B", id=11).into("HAS", "a", "A")):
        want, got = (rows_of(match(g, p).select("a.id", "b.id")) for g in graphs)
        assert want == got and want
    changed = mutate.set_properties(graphs[1], "B", {"a_id": 2})
    assert rows_of(match(changed, node("a", "A").out("HAS", "b", "B")).select("a.id", "b.id")) == [(1, 10), (1, 11)]


def test_strong_components_of_a_long_chain(spark):
    n = 104
    nodes = spark.range(1, n + 1)
    e = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(n, n - 1), (50, 49)], "src long, dst long")
    got = {r.node: r.component for r in algorithms.strong_components(nodes, e).collect()}
    assert got == {i: {n: n - 1, 50: 49}.get(i, i) for i in range(1, n + 1)}


def test_conditions_and_references_in_patterns(g):
    m = match(g, node("a", "Person", age={">": 28, "<": 50}).out("KNOWS", "b", "Person", title={"starts_with": "C"}))
    assert rows_of(m.select("a.id", "b.id")) == [(2, 3)]
    m = match(g, node("a", "Person").out("KNOWS", "b", "Person", where={"since": {"between": (2019, 2020)}}, city=Ref("a", "city")))
    assert m.count() == 0
    m = match(g, node("a", "Person").out("KNOWS", "b", "Person", city=Ref("a", "city")))
    assert rows_of(m.select("a.id", "b.id")) == [(1, 3)]
    assert rows_of(match(g, node("b", "Person", city=Ref("a", "city")), rows=match(g, node("a", "Person", name="Alice"))).select("b.id")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        match(g, node("a", "Person", city=Ref("nobody", "city")))


def test_deletes_are_counted(g):
    h = mutate.delete_nodes(g, "Person", g.nodes["Person"].where("id = 1"), detach=True)
    assert dict(h.reports[-1].counts) == {"nodes_deleted": 1, "relationships_deleted": 4}
    h = mutate.delete_edges(g, "BOUGHT", g.edge_table("BOUGHT").where("src = 2"))
    assert dict(h.reports[-1].counts) == {"relationships_deleted": 2}


def test_traversal_during_a_period_and_chosen_children(spark, g):
    e = spark.createDataFrame([(1, 2, dt.date(2020, 1, 1), dt.date(2020, 6, 1)), (1, 3, dt.date(2021, 1, 1), None)], "a long, b long, start date, until date")
    h = g.add_edges(e, "MET", "Person", "a", "Person", "b").set_temporal("MET", "start", "until")
    s = traversal.select(h, "Person").where({"id": 1})
    day = lambda x: F.lit(dt.date.fromisoformat(x))
    assert rows_of(s.traverse("MET", "out", during=(day("2020-05-01"), day("2020-12-31"))).ids()) == [(2,)]
    assert rows_of(s.traverse("MET", "out", at=day("2022-01-01")).ids()) == [(3,)]
    assert rows_of(s.traverse("MET", "out", at=day("2022-01-01"), temporal=False).ids()) == [(2,), (3,)]
    t = traversal.select(g, "Person").traverse("BOUGHT", "out")
    assert rows_of(t.collect_children("title", where={"price": {">": 3}})) == [(1, "Cup")]
    assert rows_of(t.collect_children("title", sort=[("price", "desc")], limit=1)) == [(1, "Cup"), (2, "Pen")]
    made = t.create_connections("OWNS", properties={"cost": (1, "price")}, source=1, target=0).edges["OWNS"][0]
    assert (made.src_type, made.dst_type) == ("Product", "Person") and rows_of(made.df.select("src", "dst", "cost")) == [(101, 1, 2.5), (101, 2, 2.5), (102, 1, 10.0)]


def _written(monkeypatch) -> list[int]:
    """Takes down how many rows the algorithms write between their steps."""
    rows, cut = [], algorithms.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(algorithms, "cut", counted)
    return rows


def test_strong_components_leave_out_what_lies_on_no_cycle(spark, monkeypatch):
    n = 400
    e = [(i, n + i) for i in range(n)] + [(n + i, 2 * n + i % 5) for i in range(n)] + [(2 * n + k, n + k) for k in range(5)] + [(7, 7), (n + 1, 2 * n + 1), (9999, 1)]
    nodes = spark.range(2 * n + 5)
    written = _written(monkeypatch)
    got = {r.node: r.component for r in algorithms.strong_components(nodes, spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: n + i - 2 * n if i >= 2 * n else i for i in range(2 * n + 5)}
    assert sum(written) < 6 * n


def _dbscan_by_hand(points: list[tuple], eps: float, least: int) -> dict[int, int]:
    near = {p[0]: {q[0] for q in points if q[0] != p[0] and sum((a - b) ** 2 for a, b in zip(p[1:], q[1:], strict=True)) ** 0.5 <= eps} for p in points}
    core = {i for i in near if len(near[i]) >= least}
    comp: dict[int, int] = {}
    for i in sorted(core):
        todo = [i] if i not in comp else []
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += near[j] & core
    number = {c: k for k, c in enumerate(sorted(set(comp.values())))}
    return {i: number[comp[i]] if i in core else min((number[comp[j]] for j in near[i] & core), default=-1) for i in near}


def test_dbscan_makes_no_pairs_inside_crowded_cells(spark, monkeypatch):
    rnd = random.Random(4)
    line = [(i, rnd.choice([0, 3, 9]) + rnd.gauss(0, 0.4)) for i in range(600)] + [(600 + i, 20.0 + 0.7 * i) for i in range(20)]
    written = _written(monkeypatch)
    got = dict(rows_of(algorithms.dbscan(spark.createDataFrame(line, "id long, x double"), ["x"], 0.5, 4)))
    assert got == _dbscan_by_hand(line, 0.5, 4) and max(written) < 2000
    plane = [(i, rnd.choice([0, 4]) + rnd.gauss(0, 0.6), rnd.gauss(0, 0.6)) for i in range(400)] + [(400 + i, float("inf"), 0.0) for i in range(9)]
    got = dict(rows_of(algorithms.dbscan(spark.createDataFrame(plane, "id long, x double, y double"), ["x", "y"], 0.25, 4)))
    assert {i: got[i] for i in range(400)} == _dbscan_by_hand(plane[:400], 0.25, 4) and all(got[i] == -1 for i in range(400, 409))


def test_upserts_sort_once(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    old = spark.createDataFrame([(1, 2, 5, "a"), (1, 2, None, "b"), (2, 3, 7, None)], "a long, b long, n int, t string")
    new = spark.createDataFrame([(1, 2, 10, None), (3, 4, 1, "c"), (3, 4, 1, "c"), (2, 3, None, "d")], "a long, b long, n int, t string")
    g = PropertyGraph().add_nodes(nodes, "N", "id").add_edges(old, "E", "N", "a", "N", "b")
    want = {
        "update": [(10, "a"), (10, "b"), (7, "d")], "replace": [(10, None), (10, None), (None, "d")], "skip": [(5, "a"), (None, "b"), (7, None)],
        "preserve": [(5, "a"), (10, "b"), (7, "d")], "sum": [(15, "a"), (10, "b"), (7, "d")],
    }
    for mode, values in want.items():
        h = g.add_edges(new, "E", "N", "a", "N", "b", mode=mode).edges["E"][0].df
        assert sorted(map(str, h.collect())) == sorted(str(Row(src=a, dst=b, n=n, t=t)) for (a, b), (n, t) in zip([(1, 2), (1, 2), (2, 3), (3, 4)], [*values, (1, "c")], strict=True))
    assert "FullOuter" not in h._jdf.queryExecution().optimizedPlan().toString()


def _betweenness_by_hand(n: int, edges: list[tuple[int, int]], sources: set[int]) -> dict[int, float]:
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    out = dict.fromkeys(range(n), 0.0)
    for s in sources:
        far, paths_, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v] - {v}:
                if w not in far:
                    far[w], paths_[w] = far[v] + 1, 0.0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths_[w] += paths_[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in near[w]:
                if far.get(v) == far[w] - 1:
                    dep[v] += paths_[v] / paths_[w] * (1 + dep[w])
            out[w] += dep[w]
    return out


def test_betweenness_folds_leaves(spark, monkeypatch):
    written = _written(monkeypatch)
    e = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (4, 5), (6, 7), (7, 8), (8, 8)] + [(i % 4, i) for i in range(9, 60)] + [(60, 61), (61, 1)]
    nodes, edges = spark.range(63), spark.createDataFrame(e, "src long, dst long")
    for size in (None, 20):
        chosen = {r.source for r in algorithms._sample(nodes, size)[0].collect()}
        want = _betweenness_by_hand(63, e, chosen)
        got = {r.node: r.score for r in algorithms.betweenness(nodes, edges, normalized=False, sample_size=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i] * 0.5 * 63 / len(chosen)) < 1e-9 for i in want)
    assert max(written) < 200


def test_rounds_of_labels_join_once(spark, monkeypatch):
    plans, cut = [], algorithms.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(algorithms, "cut", seen)
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], "src long, dst long")
    got = {r.node: r.community for r in algorithms.label_propagation(spark.range(1, 8), e).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and got[7] == 7 and got[1] != got[4]
    assert max(p.count("Join") for p in plans) == 1


def test_edges_of_several_types_are_not_sorted(g):
    m = match(g, node("p", "Person").out(["KNOWS", "BOUGHT"], "x", var="r"))
    assert "shuffle_hash" in m._jdf.queryExecution().optimizedPlan().toString().lower()
