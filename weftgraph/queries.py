"""Queries over the driver's tables seen as a graph, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions import dates, predicates, scalars, series, spatial, vectors
from weftgraph.operators import algorithms, inspect, integrity, mutate, paths, rows, traversal
from weftgraph.plans.pattern import count_pattern, exists, match, node, optional_match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_graphs: dict[tuple[str, str], PropertyGraph] = {}


def opened(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of a folder, whose tables are opened once in a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = trade_graph(spark, sf_dir)
    return _graphs[key]


def query(sql: str | None = None):
    def add(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(opened(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, events, users, documents and vectors, with their links.

    Keys are unique in their tables, so nothing is shuffled to build the graph; properties lose their prefixes,
    and a part's type is its kind.
    """

    def table(name: str, prefix: str = "") -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("date").alias(c.removeprefix(prefix)) if k.startswith("timestamp") and name != "events" else F.col(c).alias(c.removeprefix(prefix)) for c, k in df.dtypes])

    region, nation, customer, supplier = table("region", "r_"), table("nation", "n_"), table("customer", "c_"), table("supplier", "s_")
    part, orders, lines, events = table("part", "p_").withColumnRenamed("type", "kind"), table("orders", "o_"), table("lineitem", "l_"), table("events")
    vectors_ = table("embeddings")
    g = PropertyGraph()
    for df, kind, key, title in ((region, "Region", "regionkey", "name"), (nation, "Nation", "nationkey", "name"), (customer, "Customer", "custkey", "name"), (supplier, "Supplier", "suppkey", "name"), (part, "Part", "partkey", "name"), (orders, "Order", "orderkey", None), (events.drop("props"), "Event", "event_id", None), (vectors_.drop("embedding"), "Vec", "vec_id", None)):
        g = g.add_nodes(df, kind, key, title, unique=True)
    g = g.add_nodes(events.select("user_id").distinct(), "User", "user_id", unique=True)
    edge_columns = [c for c in lines.columns if c not in ("orderkey", "partkey", "suppkey")]
    keys = {("IN_REGION", "Nation"): ("src", "regionkey"), ("IN_NATION", "Customer"): ("src", "nationkey"), ("IN_NATION", "Supplier"): ("src", "nationkey"), ("PLACED", "Customer"): ("dst", "custkey"), ("DID", "User"): ("dst", "user_id")}
    for df, kind, a, ac, b, bc, columns in ((nation, "IN_REGION", "Nation", "nationkey", "Region", "regionkey", []), (customer, "IN_NATION", "Customer", "custkey", "Nation", "nationkey", []), (supplier, "IN_NATION", "Supplier", "suppkey", "Nation", "nationkey", []), (orders, "PLACED", "Customer", "custkey", "Order", "orderkey", []), (lines, "CONTAINS", "Order", "orderkey", "Part", "partkey", edge_columns), (lines, "SUPPLIED", "Supplier", "suppkey", "Part", "partkey", []), (lines, "FILLED_BY", "Order", "orderkey", "Supplier", "suppkey", []), (events, "DID", "User", "user_id", "Event", "event_id", [])):
        g = g.add_edges(df, kind, a, ac, b, bc, columns=columns, check=False, key=keys.get((kind, a)))
    daily = series.collect(events.where("value is not null"), "user_id", "ts", {"value": "value"})
    g = g.set_series("User", daily)
    return g.set_embeddings("Vec", "embedding", vectors_.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


# ---------------------------------------------------------------- matches


@query("""SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY total DESC, segment LIMIT 5""")
def segment_totals(g: PropertyGraph) -> DataFrame:
    m = match(g, node("c", "Customer").out("PLACED", "o", "Order")).where("o.totalprice > 100000")
    out = m.groupBy(F.col("c.mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("o.totalprice"), 2).alias("total"))
    return rows.top(out, 5, ("total", "desc"), "segment")


@query("SELECT 'Nation' AS type, count(*) AS n FROM nation")
def scan_typed(g: PropertyGraph) -> DataFrame:
    return match(g, node("n", "Nation")).groupBy("n.type").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Vec', count(*) FROM embeddings)""")
def scan_untyped(g: PropertyGraph) -> DataFrame:
    return match(g, node("n")).groupBy("n.type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_mktsegment = 'BUILDING'")
def inline_properties(g: PropertyGraph) -> DataFrame:
    return match(g, node("c", "Customer", mktsegment="BUILDING")).select("c.id", "c.title")


@query("""SELECT n_name AS nation, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA' GROUP BY 1""")
def two_hops(g: PropertyGraph) -> DataFrame:
    m = match(g, node("r", "Region", name="ASIA").into("IN_REGION", "n", "Nation").into("IN_NATION", "c", "Customer"))
    return m.groupBy(F.col("n.title").alias("nation")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity < 10 GROUP BY 1""")
def edge_properties(g: PropertyGraph) -> DataFrame:
    m = match(g, node("o", "Order").out("CONTAINS", "p", "Part", var="l")).where("l.quantity < 10")
    return m.groupBy(F.col("l.returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l.extendedprice") * (1 - F.col("l.discount"))), 2).alias("revenue"))


@query("""SELECT e, count(*) AS n FROM (SELECT 'CONTAINS' AS e FROM lineitem UNION ALL SELECT 'FILLED_BY' FROM lineitem) GROUP BY e""")
def several_edge_types(g: PropertyGraph) -> DataFrame:
    m = match(g, node("o", "Order").out(["CONTAINS", "FILLED_BY"], "x", var="r"))
    return m.groupBy(F.col("r.edge_type").alias("e")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def any_direction(g: PropertyGraph) -> DataFrame:
    return match(g, node("n", "Nation").both(["IN_NATION", "IN_REGION"], "x")).agg(F.count("*").alias("n"))


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey""")
def shared_variable(g: PropertyGraph) -> DataFrame:
    m = match(g, node("a", "Nation").out("IN_REGION", "r", "Region"), node("b", "Nation").out("IN_REGION", "r", "Region"))
    return m.where("a.id < b.id").select(F.col("a.title").alias("a"), F.col("b.title").alias("b"))


@query("""SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation WHERE n_regionkey = 0 AND r_regionkey < 2""")
def product_of_patterns(g: PropertyGraph) -> DataFrame:
    m = match(g, node("r", "Region"), node("n", "Nation", regionkey=0)).where("r.id < 2")
    return m.select(F.col("r.title").alias("region"), F.col("n.title").alias("nation"))


@query("""SELECT c_custkey AS id, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def optional(g: PropertyGraph) -> DataFrame:
    m = optional_match(g, match(g, node("c", "Customer")), node("c", "Customer").out("PLACED", "o", "Order", orderstatus="F"))
    return m.groupBy("c.id").agg(F.count("o.id").alias("n"), rows.total(F.col("o.totalprice")).alias("t")).select("id", "n", F.round("t", 2).alias("total"))


@query("""SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def exists_pattern(g: PropertyGraph) -> DataFrame:
    return exists(g, match(g, node("c", "Customer")), node("c", "Customer").out("PLACED", "o", "Order"), "o.totalprice > 300000").select("c.id")


@query("""SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def not_exists_pattern(g: PropertyGraph) -> DataFrame:
    return exists(g, match(g, node("c", "Customer")), node("c", "Customer").out("PLACED", "o", "Order"), negate=True).select("c.id")


@query("""SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer""")
def count_subquery(g: PropertyGraph) -> DataFrame:
    return count_pattern(g, match(g, node("c", "Customer")), node("c", "Customer").out("PLACED", "o", "Order"), "n").select("c.id", "n")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey + 1000 AS a, n_regionkey AS b FROM nation), w(s, t, d) AS (
SELECT n_regionkey, n_nationkey + 1000, 1 FROM nation UNION SELECT s, CASE WHEN d = 1 THEN e.b ELSE 0 END, d + 1 FROM w JOIN e ON e.a = w.t WHERE d < 2)
SELECT r_name AS region, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT DISTINCT s, t, d AS depth FROM w) JOIN region ON r_regionkey = s GROUP BY 1, 2""")
def variable_length(g: PropertyGraph) -> DataFrame:
    m = match(g, node("r", "Region").both("IN_REGION", "x", hops=(1, 2), var="depth"))
    return m.groupBy(F.col("r.title").alias("region"), F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS supplier, count(DISTINCT l_orderkey) AS orders FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def bound_rows(g: PropertyGraph) -> DataFrame:
    urgent = match(g, node("o", "Order", orderpriority="1-URGENT"))
    m = match(g, node("o", "Order").out("FILLED_BY", "s", "Supplier"), rows=urgent)
    return m.groupBy(F.col("s.id").alias("supplier")).agg(F.count_distinct("o.id").alias("orders"))


# ---------------------------------------------------------------- projection and predicates


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size,
o_orderstatus IN ('F', 'O') AS known, o_orderpriority LIKE '1%' AS urgent, contains(o_orderpriority, 'HIGH') AS high,
regexp_matches(o_orderpriority, '[45]-') AS low, (o_orderstatus = 'F') <> (o_totalprice > 100000) AS either FROM orders""")
def predicates_and_case(g: PropertyGraph) -> DataFrame:
    o = match(g, node("o", "Order"))
    price, status, prio = F.col("o.totalprice"), F.col("o.orderstatus"), F.col("o.orderpriority")
    return o.select("o.id", F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small").alias("size"), predicates.is_in(status, ["F", "O"]).alias("known"), predicates.is_true(prio.startswith("1")).alias("urgent"), predicates.is_true(prio.contains("HIGH")).alias("high"), predicates.matches(prio, "[45]-").alias("low"), predicates.xor(status == "F", price > 100000).alias("either"))


@query("""SELECT event_id AS id, NOT coalesce(value < 50, false) AS not_small, coalesce(value <> 1, true) AS differs, value IS NULL AS missing FROM events""")
def two_valued_logic(g: PropertyGraph) -> DataFrame:
    v = F.col("e.value")
    return match(g, node("e", "Event")).select("e.id", predicates.not_(v < 50).alias("not_small"), predicates.ne(v, 1).alias("differs"), v.isNull().alias("missing"))


@query("""SELECT p_partkey AS id, upper(p_name) AS up, lower(p_brand) AS low, strlen(p_name) AS bytes, replace(p_type, ' ', '_') AS type_, substr(p_name, 3, 4) AS part, left(p_name, 3) AS l,
right(p_name, 3) AS r, reverse(p_brand) AS rev, levenshtein(p_brand, p_type) AS edit, string_split(p_type, ' ')[1] AS first_word, string_split(p_type, ' ')[-1] AS last_word, len(string_split(p_type, ' ')) AS words FROM part""")
def text_functions(g: PropertyGraph) -> DataFrame:
    name, brand, kind = F.col("p.title"), F.col("p.brand"), F.col("p.kind")
    words = scalars.split(kind, " ")
    return match(g, node("p", "Part")).select("p.id", F.upper(name).alias("up"), F.lower(brand).alias("low"), scalars.size_of_text(name).cast("bigint").alias("bytes"), F.replace(kind, F.lit(" "), F.lit("_")).alias("type_"), scalars.substring(name, 2, 4).alias("part"), scalars.left(name, 3).alias("l"), scalars.right(name, 3).alias("r"), F.reverse(brand).alias("rev"), scalars.edit_distance(brand, kind).cast("bigint").alias("edit"), scalars.head(words).alias("first_word"), scalars.last(words).alias("last_word"), F.size(words).cast("bigint").alias("words"))


@query("""SELECT o_orderkey AS id, ceil(o_totalprice) AS up, floor(o_totalprice) AS down, round(o_totalprice) AS near, sqrt(o_totalprice) AS root, ln(o_totalprice) AS log_e, log10(o_totalprice) AS log_ten,
abs(o_totalprice - 150000) AS gap, CAST(sign(o_totalprice - 150000) AS INTEGER) AS side, o_orderkey // 7 AS whole, o_orderkey % 7 AS rest, o_totalprice / nullif(o_orderkey % 5, 0) AS share FROM orders""")
def number_functions(g: PropertyGraph) -> DataFrame:
    p, k = F.col("o.totalprice"), F.col("o.id")
    return match(g, node("o", "Order")).select("o.id", scalars.ceil(p).alias("up"), scalars.floor(p).alias("down"), scalars.round_(p).alias("near"), scalars.sqrt(p).alias("root"), scalars.ln(p).alias("log_e"), scalars.log10(p).alias("log_ten"), F.abs(p - 150000).alias("gap"), scalars.sign(p - 150000).alias("side"), scalars.divide(k, F.lit(7), whole=True).alias("whole"), scalars.modulo(k, F.lit(7)).alias("rest"), scalars.divide(p, k % 5).alias("share"))


@query("""SELECT n_nationkey AS id, array_to_string(list_transform(range(0, n_nationkey + 1), lambda x: x * 2), ',') AS doubled, len(list_filter(range(0, n_nationkey + 1), lambda x: x % 3 = 0)) AS thirds,
CAST(list_sum(range(0, n_nationkey + 1)) AS BIGINT) AS total, n_nationkey >= 3 AS has_three, n_nationkey < 10 AS all_small FROM nation""")
def list_functions(g: PropertyGraph) -> DataFrame:
    k = F.col("n.id").cast("bigint")
    numbers = scalars.range_(F.lit(0).cast("bigint"), k)
    return match(g, node("n", "Nation")).select("n.id", F.array_join(scalars.comprehension(numbers, of=lambda x: x * 2), ",").alias("doubled"), F.size(scalars.comprehension(numbers, where=lambda x: x % 3 == 0)).cast("bigint").alias("thirds"), scalars.reduce(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), scalars.any_of(numbers, lambda x: x == 3).alias("has_three"), scalars.all_of(numbers, lambda x: x < 10).alias("all_small"))


@query(r"""SELECT o_orderkey AS id, year(d) AS y, month(d) AS m, day(d) AS d, isodow(d) AS dow, dayofyear(d) AS doy, CAST(epoch(d) AS BIGINT) AS secs, date_diff('day', d, DATE '2000-01-01') AS gap,
CAST(CAST(d + 40 AS DATE) AS VARCHAR) AS later, d >= DATE '1995-01-01' AND d <= DATE '1995-12-31' AS valid FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_functions(g: PropertyGraph) -> DataFrame:
    d = F.col("o.orderdate")
    day = lambda s: dates.date(F.lit(s))
    big = lambda c: c.cast("bigint")
    return match(g, node("o", "Order")).select("o.id", big(F.year(d)).alias("y"), big(F.month(d)).alias("m"), big(F.dayofmonth(d)).alias("d"), big(dates.day_of_week(d)).alias("dow"), big(F.dayofyear(d)).alias("doy"), dates.epoch_seconds(d).alias("secs"), big(dates.date_diff(day("2000"), d)).alias("gap"), dates.add(d, dates.duration(months=1, days=10)).cast("string").alias("later"), dates.valid_at(d, day("1995"), day("1995-12-31")).alias("valid"))


@query("""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS plain, len(p_name) - 1 AS bigrams,
contains(p_name, 'a') OR contains(p_name, 'e') AS vowels FROM part""")
def semantic_text(g: PropertyGraph) -> DataFrame:
    t = F.col("p.title")
    return match(g, node("p", "Part")).select("p.id", scalars.normalize(t).alias("plain"), F.size(scalars.ngrams(t, 2)).cast("bigint").alias("bigrams"), scalars.contains_any(t, ["a", "e"]).alias("vowels"))


# ---------------------------------------------------------------- aggregation, order, windows, sets


@query("""SELECT c_nationkey AS nation, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high,
round(stddev_samp(c_acctbal), 6) AS std, round(var_samp(c_acctbal), 4) AS var, round(median(c_acctbal), 6) AS med, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, quantile_disc(c_acctbal, 0.75) AS q3,
array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS names FROM customer GROUP BY 1""")
def aggregates(g: PropertyGraph) -> DataFrame:
    b = F.col("c.acctbal")
    m = match(g, node("c", "Customer"))
    return m.groupBy(F.col("c.nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_distinct("c.mktsegment").alias("segments"), F.round(rows.total(b), 2).alias("total"), F.round(F.avg(b), 6).alias("mean"), F.min(b).alias("low"), F.max(b).alias("high"), F.round(rows.std(b), 6).alias("std"), F.round(rows.variance(b), 4).alias("var"), F.round(rows.median(b), 6).alias("med"), F.round(rows.percentile_cont(b, 0.25), 6).alias("q1"), rows.percentile_disc("c.acctbal", 0.75).alias("q3"), F.array_join(rows.collect(F.col("c.mktsegment"), distinct=True), ",").alias("names"))


@query("""SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15""")
def having(g: PropertyGraph) -> DataFrame:
    m = match(g, node("c", "Customer").out("PLACED", "o", "Order"))
    return m.groupBy(F.col("c.id").alias("customer")).agg(F.count("*").alias("n")).where("n > 15")


@query("""SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders""")
def windows(g: PropertyGraph) -> DataFrame:
    o = match(g, node("o", "Order")).select("o.*")
    o = rows.ranked(o, "rn", "row_number", ["custkey"], F.desc("totalprice"), F.col("id"))
    o = rows.ranked(o, "rk", "rank", ["custkey"], F.col("orderpriority"))
    return rows.ranked(o, "dr", "dense_rank", ["custkey"], F.col("orderpriority")).select("id", *[F.col(c).cast("bigint").alias(c) for c in ("rn", "rk", "dr")])


@query("""SELECT event_id AS id, value FROM events ORDER BY value DESC NULLS FIRST, event_id LIMIT 20 OFFSET 5""")
def order_skip_limit(g: PropertyGraph) -> DataFrame:
    return rows.top(match(g, node("e", "Event")).select("e.id", "e.value"), 20, ("value", "desc"), "id", skip=5)


@query("""SELECT c_custkey AS customer, o_orderkey AS id FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2""")
def top_per_group(g: PropertyGraph) -> DataFrame:
    m = match(g, node("c", "Customer").out("PLACED", "o", "Order")).select(F.col("c.id").alias("customer"), "o.id", "o.totalprice")
    return rows.per_group(m, ["customer"], [("totalprice", "desc"), "id"], 2).select("customer", "id")


@query("""SELECT n_nationkey AS id, CAST(unnest(range(0, n_regionkey + 1)) AS BIGINT) AS x FROM nation""")
def unwound(g: PropertyGraph) -> DataFrame:
    return rows.unwind(match(g, node("n", "Nation")), scalars.range_(F.lit(0).cast("bigint"), F.col("n.regionkey").cast("bigint")), "x").select("n.id", "x")


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(g: PropertyGraph) -> DataFrame:
    return rows.union(*_nation_keys(g))


@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
def union_all(g: PropertyGraph) -> DataFrame:
    return rows.union(*_nation_keys(g), all_rows=True)


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersection(g: PropertyGraph) -> DataFrame:
    return rows.intersect(*_nation_keys(g))


@query("""SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier""")
def difference(g: PropertyGraph) -> DataFrame:
    return rows.except_(*_nation_keys(g))


def _nation_keys(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    return match(g, node("c", "Customer")).select(F.col("c.nationkey").alias("k")), match(g, node("s", "Supplier")).select(F.col("s.nationkey").alias("k"))


# ---------------------------------------------------------------- fluent selections


@query("""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 AND o_orderpriority NOT LIKE '%LOW%' """)
def fluent_traverse(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer").where({"mktsegment": "BUILDING", "acctbal": {"between": (0, 5000)}})
    return s.traverse("PLACED", "out", where={"orderpriority": {"not_contains": "LOW"}}).ids()


@query("""SELECT c_custkey AS l0, count(*) AS count, count(o_totalprice) AS valid_count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max, round(stddev_samp(o_totalprice), 4) AS std
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def fluent_statistics(g: PropertyGraph) -> DataFrame:
    out = traversal.select(g, "Customer").traverse("PLACED", "out").statistics("totalprice")
    return out.select("l0", "count", "valid_count", F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg"), "min", "max", F.round("std", 4).alias("std"))


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) AND (s_acctbal < 0 OR s_nationkey IN (1, 2, 3))""")
def fluent_filters(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Supplier").where_connected("SUPPLIED", "out").where_any([{"acctbal": {"<": 0}}, {"nationkey": [1, 2, 3]}]).ids()


@query("""SELECT c_custkey AS id FROM customer WHERE (c_nationkey < 10) <> (c_mktsegment = 'BUILDING')""")
def fluent_sets(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer")
    return s.where({"nationkey": {"<": 10}}).symmetric_difference(s.where({"mktsegment": "BUILDING"})).ids()


@query("""SELECT r_regionkey AS l0, string_agg(n_name, ', ' ORDER BY n_name) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def fluent_children(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Region").traverse("IN_REGION", "in").collect_children("title")


@query("""SELECT c_custkey AS l0, round(sum(o_totalprice) / count(*), 4) AS mean_price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def fluent_calculate(g: PropertyGraph) -> DataFrame:
    out = traversal.select(g, "Customer").traverse("PLACED", "out").calculate("sum(totalprice) / count(*)", "m")
    return out.select("l0", F.round("m", 4).alias("mean_price"))


@query("""SELECT c_custkey AS l0, o_orderkey AS l1 FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 3""")
def fluent_limit(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Customer").traverse("PLACED", "out", limit=3).keys


@query("""SELECT DISTINCT c_nationkey AS src, l_partkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 7""")
def fluent_new_edges(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Nation").where({"id": 7}).traverse("IN_NATION", "in", to="Customer").traverse("PLACED", "out").traverse("CONTAINS", "out")
    return s.create_connections("BUYS").edges["BUYS"][0].df


# ---------------------------------------------------------------- algorithms


@query("""SELECT n_nationkey AS node, 1 + coalesce(c, 0) + coalesce(s, 0) AS degree FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON b.k = n_nationkey""")
def degree(g: PropertyGraph) -> DataFrame:
    e = g.edge_table(["IN_NATION", "IN_REGION"])
    ends = e.select(F.when(F.col("src_type") == "Nation", F.col("src")).alias("src"), F.when(F.col("dst_type") == "Nation", F.col("dst")).alias("dst"))
    return algorithms.degrees(g.nodes["Nation"], ends).select("node", "degree")


def _bipartite(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Customers and orders as one set of nodes."""
    e = g.edge_table("PLACED").select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    nodes = g.nodes["Customer"].select((F.col("id") * 2).alias("id")).union(g.nodes["Order"].select((F.col("id") * 2 + 1).alias("id")))
    return nodes, e


@query("""SELECT least(c_custkey * 2, coalesce(min(o_orderkey * 2 + 1), c_custkey * 2)) AS component, 1 + count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def components(g: PropertyGraph) -> DataFrame:
    return algorithms.connected_components(*_bipartite(g)).groupBy("component").agg(F.count("*").alias("size"))


def _chain(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Customers, orders and suppliers as one set of nodes: customers lead to their orders, and these to who filled them."""
    key = lambda c, k: (F.col(c).cast("bigint") * 3 + k)
    placed = g.edge_table("PLACED").select(key("src", 0).alias("src"), key("dst", 1).alias("dst"))
    filled = g.edge_table("FILLED_BY").select(key("src", 1).alias("src"), key("dst", 2).alias("dst"))
    nodes = [g.nodes[t].select(key("id", k).alias("id")) for k, t in enumerate(("Customer", "Order", "Supplier"))]
    return nodes[0].union(nodes[1]).union(nodes[2]), placed.union(filled)


_CHAIN = """n AS (SELECT c_custkey * 3 AS id FROM customer UNION ALL SELECT o_orderkey * 3 + 1 FROM orders UNION ALL SELECT s_suppkey * 3 + 2 FROM supplier),
e AS (SELECT o_custkey * 3 AS src, o_orderkey * 3 + 1 AS dst FROM orders UNION ALL SELECT l_orderkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem)"""


def _ranks(rounds: int) -> str:
    """Rounds of PageRank, written out."""
    out = f"""WITH {_CHAIN}, t AS (SELECT count(*) AS m FROM n), s AS (SELECT src, dst, count(*) * 1.0 / any_value(o) AS share FROM e JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) USING (src) GROUP BY 1, 2),
h AS (SELECT id, id NOT IN (SELECT src FROM e) AS hangs FROM n), r0 AS (SELECT id, 1.0 / m AS r FROM n, t)"""
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out += f""", r{i} AS MATERIALIZED (SELECT n.id, 0.15 / m + 0.85 * (SELECT coalesce(sum(r), 0) FROM {p} JOIN h USING (id) WHERE hangs) / m + 0.85 * coalesce(g, 0) AS r
FROM n CROSS JOIN t LEFT JOIN (SELECT dst AS id, sum(share * r) AS g FROM s JOIN {p} ON {p}.id = s.src GROUP BY 1) x ON x.id = n.id)"""
    return out + f" SELECT id AS node, round(r * 1000000, 4) AS score FROM r{rounds}"


@query(_ranks(6))
def pagerank(g: PropertyGraph) -> DataFrame:
    return algorithms.pagerank(*_chain(g), rounds=6, tolerance=0.0).select("node", F.round(F.col("score") * 1000000, 4).alias("score"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS d FROM orders GROUP BY 1), t AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS m)
SELECT c_custkey * 2 AS node, round(coalesce(d, 0) * (coalesce(d, 0) - 1.0) / ((m - 1.0) * (m - 2)), 12) AS score FROM customer CROSS JOIN t LEFT JOIN c ON k = c_custkey
UNION ALL SELECT o_orderkey * 2 + 1, 0.0 FROM orders""")
def betweenness(g: PropertyGraph) -> DataFrame:
    return algorithms.betweenness(*_bipartite(g)).select("node", F.round("score", 12).alias("score"))


@query(f"""WITH {_CHAIN}, t AS (SELECT count(*) AS m FROM n), f AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS o, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT s * 3 + 2 AS id, count(*) AS a, count(DISTINCT c) AS b FROM f GROUP BY 1 UNION ALL SELECT o_orderkey * 3 + 1, 1, 0 FROM orders)
SELECT n.id AS node, round(coalesce((a + b) * 1.0 / (a + 2 * b) * (a + b) / (m - 1), 0), 10) AS score FROM n CROSS JOIN t LEFT JOIN r USING (id)""")
def closeness(g: PropertyGraph) -> DataFrame:
    return algorithms.closeness(*_chain(g)).select("node", F.round("score", 10).alias("score"))


@query("""SELECT c_custkey * 2 AS node, CAST(count(o_orderkey) AS DOUBLE) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT o_orderkey * 2 + 1, 1.0 FROM orders""")
def degree_centrality(g: PropertyGraph) -> DataFrame:
    return algorithms.degree_centrality(*_bipartite(g), normalized=False)


@query()
def louvain(g: PropertyGraph) -> DataFrame:
    return algorithms.louvain(*_bipartite(g), rounds=10)


@query()
def label_propagation(g: PropertyGraph) -> DataFrame:
    return algorithms.label_propagation(*_bipartite(g), rounds=5)


@query(f"""WITH RECURSIVE {_CHAIN}, u AS (SELECT o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'), x AS (SELECT DISTINCT l_orderkey * 3 + 1 AS a, l_suppkey * 3 + 2 AS b FROM lineitem JOIN u ON o = l_orderkey),
b AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x), w(id, r) AS (SELECT min(a), min(a) FROM b UNION SELECT b.b, w.r FROM w JOIN b ON b.a = w.id)
SELECT n.id AS node, coalesce(w.r, n.id) AS component FROM n LEFT JOIN w USING (id)""")
def strong_components(g: PropertyGraph) -> DataFrame:
    """Urgent orders and their suppliers lead to each other, all else one way."""
    nodes, edges = _chain(g)
    urgent = g.nodes["Order"].where("orderpriority = '1-URGENT'").select((F.col("id") * 3 + 1).alias("src"))
    back = edges.join(urgent, "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return algorithms.strong_components(nodes, edges.union(back))


@query("""WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), c AS (SELECT id, x FROM (SELECT id, x, count(*) OVER (ORDER BY x RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING) - 1 AS k FROM p) WHERE k >= 2),
i AS (SELECT id, x, sum(new) OVER (ORDER BY x, id) AS g FROM (SELECT id, x, CASE WHEN x - lag(x) OVER (ORDER BY x, id) <= 200 THEN 0 ELSE 1 END AS new FROM c)),
m AS (SELECT id, x, min(id) OVER (PARTITION BY g) AS comp FROM i), k AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM m)),
f AS (SELECT id, comp FROM m UNION ALL SELECT p.id, min(m.comp) FROM p JOIN m ON abs(p.x - m.x) <= 200 WHERE p.id NOT IN (SELECT id FROM c) GROUP BY 1)
SELECT p.id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM p LEFT JOIN f ON f.id = p.id LEFT JOIN k ON k.comp = f.comp""")
def dbscan(g: PropertyGraph) -> DataFrame:
    return algorithms.dbscan(g.nodes["Supplier"], ["acctbal"], eps=200.0, min_points=2)


@query()
def kmeans(g: PropertyGraph) -> DataFrame:
    return algorithms.kmeans(g.nodes["Customer"], ["acctbal", "nationkey"], k=4, normalize=True)


@query("""SELECT a.n_nationkey AS source, b.n_nationkey AS target, 2 AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey < 5""")
def shortest_path(g: PropertyGraph) -> DataFrame:
    e = g.edge_table("IN_REGION").select("src", (F.col("dst") + 1000).alias("dst"))
    ids = g.nodes["Nation"].select("id")
    pairs = ids.where("id < 5").select(F.col("id").alias("source")).crossJoin(ids.select(F.col("id").alias("target")))
    return paths.shortest_paths(e, pairs).select("source", "target", "hops")


@query("""SELECT n_nationkey AS node, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS cost FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 1000, 0.0""")
def weighted_path(g: PropertyGraph) -> DataFrame:
    e = g.edge_table("IN_REGION").select("src", (F.col("dst") + 1000).alias("dst"), (F.col("src") % 7 + 1).alias("w"))
    start = g.nodes["Region"].where("id = 0").select((F.col("id") + 1000).alias("source"))
    return paths.cheapest(e, start, "w").select("node", "cost")


@query("""SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 0 AND b.n_nationkey = 5""")
def simple_paths(g: PropertyGraph) -> DataFrame:
    e = g.edge_table("IN_REGION").select("src", (F.col("dst") + 1000).alias("dst"))
    return paths.all_paths(e, 0, 5, max_hops=4, directed=False).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- integrity


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rule_missing_required_edge(g: PropertyGraph) -> DataFrame:
    return integrity.missing_required_edge(g, "Customer", "PLACED").select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def rule_orphans(g: PropertyGraph) -> DataFrame:
    return integrity.orphan_nodes(g, "Part").select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)")
def rule_duplicate_titles(g: PropertyGraph) -> DataFrame:
    return integrity.duplicate_titles(g, "Part").select("id")


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS edge_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def rule_parallel_edges(g: PropertyGraph) -> DataFrame:
    return integrity.parallel_edges(g, "SUPPLIED").select("src", "dst", "edge_count")


@query("SELECT o_orderkey AS id, count(l_orderkey) AS edge_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) NOT BETWEEN 2 AND 6")
def rule_cardinality(g: PropertyGraph) -> DataFrame:
    return integrity.cardinality_violations(g, "Order", "CONTAINS", 2, 6).select("id", "edge_count")


@query("SELECT count(*) AS n FROM supplier")
def rule_domain(g: PropertyGraph) -> DataFrame:
    return integrity.type_domain_violations(g, "IN_NATION", "Customer").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id FROM events WHERE value IS NULL")
def rule_null_property(g: PropertyGraph) -> DataFrame:
    return integrity.null_property(g, "Event", "value").select("id")


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS s, s_nationkey AS d FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_totalprice < 5000)
SELECT x.s AS a, x.d AS b FROM e x JOIN e y ON x.s = y.d AND x.d = y.s WHERE x.s < x.d""")
def rule_two_cycles(g: PropertyGraph) -> DataFrame:
    m = match(g, node("a", "Nation").into("IN_NATION", "c", "Customer").out("PLACED", "o", "Order").out("FILLED_BY", "s", "Supplier").out("IN_NATION", "b", "Nation")).where("o.totalprice < 5000")
    pairs = m.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()
    g = g.add_edges(pairs, "TRADES", "Nation", "src", "Nation", "dst", check=False)
    return integrity.cycles_of_two(g, "Nation", "TRADES")


# ---------------------------------------------------------------- series, vectors, places, validity


@query("""SELECT user_id AS id, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND CAST(ts AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) FROM events) AND DATE '2099-12-31' GROUP BY 1""")
def series_sum(g: PropertyGraph) -> DataFrame:
    return series.aggregate(g.series["User"], "value", "sum", None, "2099").select("id", F.round("value", 4).alias("total"))


@query("""SELECT user_id AS id, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")
def series_count(g: PropertyGraph) -> DataFrame:
    return series.aggregate(g.series["User"], "value", "count", name="n")


@query("""SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings""")
def vector_score(g: PropertyGraph) -> DataFrame:
    v = g.embeddings[("Vec", "embedding")]
    q = v.where("id = 0").select(F.col("vector").alias("q")).limit(1)
    return v.join(F.broadcast(q)).select("id", F.round(vectors.score(F.col("vector"), F.col("q")), 5).alias("score"))


@query("""SELECT label, round(sum(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 3) AS norms FROM embeddings GROUP BY 1""")
def embedding_norms(g: PropertyGraph) -> DataFrame:
    m = g.nodes["Vec"].join(g.embeddings[("Vec", "embedding")], "id")
    return m.groupBy("label").agg(F.round(F.sum(vectors.norm(F.col("vector"))), 3).alias("norms"))


@query("""SELECT vec_id AS id FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10""")
def vector_search(g: PropertyGraph) -> DataFrame:
    q = g.embeddings[("Vec", "embedding")].where("id = 3").first()
    return traversal.select(g, "Vec").vector_search("embedding", list(q.vector) if q else [0.0], 10, "euclidean").select("id")


def _places(g: PropertyGraph, kind: str) -> DataFrame:
    """Made-up places: latitude and longitude from the key."""
    return g.nodes[kind].select("id", (F.pmod(F.col("id") * 37, F.lit(120)) - 60.0).alias("lat"), (F.pmod(F.col("id") * 53, F.lit(340)) - 170.0).alias("lon"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey * 37 % 120 - 60.0 AS lat, c_custkey * 53 % 340 - 170.0 AS lon FROM customer)
SELECT id FROM p WHERE lat BETWEEN -10 AND 20 AND lon BETWEEN 0 AND 90""")
def within_bounds(g: PropertyGraph) -> DataFrame:
    return _places(g, "Customer").where(spatial.within_bounds(F.col("lat"), F.col("lon"), -10, 0, 20, 90)).select("id")


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey * 37 % 120 - 60.0 AS y, c_custkey * 53 % 340 - 170.0 AS x FROM customer)
SELECT CAST(k AS BIGINT) AS a_id, id AS b_id FROM p, (SELECT unnest(range(0, 12)) AS k) s WHERE y > -60 AND y < 60 AND x > -170 + 28 * k AND x < -170 + 28 * k + 28""")
def containment_join(g: PropertyGraph) -> DataFrame:
    spark = g.nodes["Customer"].sparkSession
    west = F.col("id") * 28 - 170
    east = west + 28
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), F.lit(str(y)))
    ring = F.concat_ws(", ", corner(west, -60), corner(east, -60), corner(east, 60), corner(west, 60), corner(west, -60))
    shapes = spark.range(12).select(F.col("id").alias("a_id"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("w"))
    points = _places(g, "Customer").withColumnRenamed("id", "b_id")
    return spatial.containment_join(shapes, points, "w", "lat", "lon", 10.0).select("a_id", "b_id")


_PLACES = """a AS (SELECT s_suppkey AS id, s_suppkey * 37 % 120 - 60.0 AS lat, s_suppkey * 53 % 340 - 170.0 AS lon FROM supplier),
b AS (SELECT n_nationkey AS id, n_nationkey * 37 % 120 - 60.0 AS lat, n_nationkey * 53 % 340 - 170.0 AS lon FROM nation)"""
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f"""WITH {_PLACES} SELECT a.id AS a_id, b.id AS b_id FROM a, b WHERE {_HAVERSINE} <= 500000""")
def distance_join(g: PropertyGraph) -> DataFrame:
    return spatial.distance_join(_places(g, "Supplier"), _places(g, "Nation"), 500_000).select("a_id", "b_id")


@query(f"""WITH a AS (SELECT 10.0 AS lat, 20.0 AS lon), b AS (SELECT c_custkey AS id, c_custkey * 37 % 120 - 60.0 AS lat, c_custkey * 53 % 340 - 170.0 AS lon FROM customer)
SELECT id FROM (SELECT b.id, {_HAVERSINE} AS d FROM a, b) ORDER BY d, id LIMIT 10""")
def nearest_neighbours(g: PropertyGraph) -> DataFrame:
    return spatial.nearest(_places(g, "Customer"), 10.0, 20.0, 10).select("id")


@query("""SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1996-06-30'""")
def valid_on_day(g: PropertyGraph) -> DataFrame:
    o = g.nodes["Order"].withColumn("until", F.date_add("orderdate", 30))
    g = PropertyGraph(nodes={"Order": o}, info=g.info).set_temporal("Order", "orderdate", "until")
    return traversal.select(g, "Order").valid_at(dates.date(F.lit("1996-06-30"))).ids()


# ---------------------------------------------------------------- changes and inspection


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' END AS note FROM customer""")
def set_property(g: PropertyGraph) -> DataFrame:
    return mutate.set_properties(g, "Customer", {"note": "debt"}, "acctbal < 0").nodes["Customer"].select("id", "note")


@query("""SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS nodes, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0) AS edges""")
def detach_delete(g: PropertyGraph) -> DataFrame:
    g = mutate.delete_nodes(g, "Customer", g.nodes["Customer"].where("acctbal < 0"), detach=True)
    return g.nodes["Customer"].agg(F.count("*").alias("nodes")).join(g.edge_table("PLACED").agg(F.count("*").alias("edges")))


@query("""SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey < 3 THEN 'new' END AS state FROM nation UNION ALL SELECT 100, 'ATLANTIS', 'new'""")
def upsert(g: PropertyGraph) -> DataFrame:
    new = g.nodes["Nation"].where("id < 3").select("id", "title", F.lit("new").alias("state"))
    extra = new.limit(1).select(F.lit(100).alias("id"), F.lit("ATLANTIS").alias("title"), F.lit("new").alias("state"))
    return g.add_nodes(new.union(extra), "Nation", "id", "title").nodes["Nation"].select("id", "title", "state")


@query("""SELECT mktsegment AS title, n FROM (SELECT c_mktsegment AS mktsegment, 1 AS n FROM customer GROUP BY 1)""")
def merge(g: PropertyGraph) -> DataFrame:
    spark = g.nodes["Nation"].sparkSession
    empty = spark.createDataFrame([], "id bigint, title string")
    g2 = PropertyGraph(nodes={**g.nodes, "Segment": empty})
    g2 = mutate.merge_nodes(g2, "Segment", g.nodes["Customer"].select(F.col("mktsegment").alias("title")), ["title"])
    g2 = mutate.merge_nodes(g2, "Segment", g.nodes["Customer"].select(F.col("mktsegment").alias("title")), ["title"])
    return g2.nodes["Segment"].groupBy("title").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT 'Nation' AS src_type, 'IN_REGION' AS edge_type, 'Region' AS dst_type, count(*) AS n FROM nation UNION ALL SELECT 'Customer', 'IN_NATION', 'Nation', count(*) FROM customer UNION ALL SELECT 'Supplier', 'IN_NATION', 'Nation', count(*) FROM supplier
UNION ALL SELECT 'Customer', 'PLACED', 'Order', count(*) FROM orders UNION ALL SELECT 'Order', 'CONTAINS', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Supplier', 'SUPPLIED', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Order', 'FILLED_BY', 'Supplier', count(*) FROM lineitem
UNION ALL SELECT 'User', 'DID', 'Event', count(*) FROM events""")
def connectivity(g: PropertyGraph) -> DataFrame:
    return inspect.connectivity(g)


@query("""SELECT 'mktsegment' AS property, count(c_mktsegment) AS filled FROM customer UNION ALL SELECT 'acctbal', count(c_acctbal) FROM customer UNION ALL SELECT 'nationkey', count(c_nationkey) FROM customer UNION ALL SELECT 'id', count(*) FROM customer UNION ALL SELECT 'title', count(*) FROM customer""")
def property_summary(g: PropertyGraph) -> DataFrame:
    return inspect.properties(g, "Customer").select("property", "filled")


@query("""SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3""")
def induced_subgraph(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer").where({"nationkey": 3})
    sub = traversal.subgraph(g, {"Customer": s.ids(), "Order": s.traverse("PLACED", "out").ids()})
    return sub.edge_table("PLACED").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey AS nation, c_mktsegment AS segment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def ranked_groups(g: PropertyGraph) -> DataFrame:
    n = match(g, node("c", "Customer")).groupBy(F.col("c.nationkey").alias("nation"), F.col("c.mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("n"), "segment"))
    return n.withColumn("r", r).where("r = 1").drop("r")
