"""Further queries over the driver's tables: functions of values, fluent steps, changes and rules, several to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.catalog import PropertyGraph
from weftgraph.functions import dates, scalars, series, spatial
from weftgraph.operators import inspect, integrity, mutate, paths, rows, traversal
from weftgraph.plans.pattern import Ref, exists, match, node, optional_match
from weftgraph.queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]  # all queries: those of this module join those of `queries`

# ---------------------------------------------------------------- patterns


@query("""SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 250000 AND o_orderpriority LIKE '2%' AND o_orderstatus IN ('F', 'P')""")
def pattern_comparisons(g: PropertyGraph) -> DataFrame:
    m = match(g, node("o", "Order", totalprice={">": 100_000, "<=": 250_000}, orderpriority={"starts_with": "2"}, orderstatus=["F", "P"]))
    return m.select("o.id", F.col("o.totalprice").alias("price"))


@query("""SELECT l_orderkey AS o, l_linenumber AS line, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity BETWEEN 10 AND 20 AND p_size >= 40 AND p_type LIKE '%STEEL'""")
def pattern_ranges(g: PropertyGraph) -> DataFrame:
    m = match(g, node("o", "Order").out("CONTAINS", "p", "Part", var="l", where={"quantity": {"between": (10, 20)}}, size={">=": 40}, kind={"ends_with": "STEEL"}))
    return m.select(F.col("o.id").alias("o"), F.col("l.linenumber").alias("line"), F.col("l.quantity").alias("quantity"))


@query("""SELECT c_custkey AS c, s_suppkey AS s, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey GROUP BY 1, 2""")
def pattern_across_variables(g: PropertyGraph) -> DataFrame:
    m = match(g, node("c", "Customer").out("PLACED", "o", "Order").out("FILLED_BY", "s", "Supplier", nationkey=Ref("c", "nationkey")))
    return m.groupBy(F.col("c.id").alias("c"), F.col("s.id").alias("s")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE s_acctbal < 0 AND c_acctbal < 0""")
def correlated_join(g: PropertyGraph) -> DataFrame:
    first = match(g, node("s", "Supplier", acctbal={"<": 0}))
    m = match(g, node("c", "Customer", acctbal={"<": 0}, nationkey=Ref("s", "nationkey")), rows=first)
    return m.select(F.col("s.id").alias("s"), F.col("c.id").alias("c"))


@query("""SELECT n_nationkey AS id, count(s_suppkey) AS poor FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 1000 GROUP BY 1""")
def optional_with_comparison(g: PropertyGraph) -> DataFrame:
    m = optional_match(g, match(g, node("n", "Nation")), node("n", "Nation").into("IN_NATION", "s", "Supplier", acctbal={"<": 1000}))
    return m.groupBy("n.id").agg(F.count("s.id").alias("poor"))


@query("""SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_discount > 0.09)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def nested_exists(g: PropertyGraph) -> DataFrame:
    m = match(g, node("c", "Customer"))
    m = exists(g, m, node("c", "Customer").out("PLACED", "o", "Order").out("CONTAINS", "p", "Part", var="l", where={"discount": {">": 0.09}}))
    return exists(g, m, node("c", "Customer").out("PLACED", "o", "Order", orderstatus="P"), negate=True).select("c.id")


@query("""SELECT 'CONTAINS' AS kind, l_orderkey AS src, l_partkey AS dst, 'Order' AS src_type, l_tax AS tax FROM lineitem WHERE l_returnflag = 'A'""")
def relationship_parts(g: PropertyGraph) -> DataFrame:
    """type(r), its ends and a property."""
    m = match(g, node("o", "Order").out("CONTAINS", "p", "Part", var="r", where={"returnflag": "A"}))
    return m.select(F.col("r.edge_type").alias("kind"), "r.src", "r.dst", "r.src_type", "r.tax")


@query("""SELECT 'Nation' AS label, n_nationkey AS id, n_name AS title, n_regionkey AS regionkey FROM nation""")
def return_everything(g: PropertyGraph) -> DataFrame:
    return match(g, node("n", "Nation")).select("n.*").withColumnRenamed("type", "label")


@query("""SELECT event_id AS id, 'Event' AS label, CASE WHEN value IS NULL THEN 'event_type,id' ELSE 'event_type,id,value' END AS filled, coalesce(value, -1) AS value, true AS is_event FROM events""")
def entity_functions(g: PropertyGraph) -> DataFrame:
    """labels, keys, coalesce and the check of a label."""
    m = match(g, node("e", "Event"))
    return m.select("e.id", F.element_at(scalars.labels("e"), 1).alias("label"), F.array_join(scalars.keys("e", ["id", "event_type", "value"]), ",").alias("filled"), F.coalesce("e.value", F.lit(-1.0)).alias("value"), (F.col("e.type") == "Event").alias("is_event"))


# ---------------------------------------------------------------- functions


@query("""SELECT p_partkey AS id, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS number, TRY_CAST(CASE WHEN regexp_full_match(trim(p_name), '[+-]?[0-9]+') THEN p_name END AS BIGINT) AS no_number,
CAST(trunc(p_retailprice) AS BIGINT) AS whole, TRY_CAST(CAST(p_size AS VARCHAR) || '.5' AS DOUBLE) AS half, CAST(p_size AS VARCHAR) AS text, 'null' AS nothing, p_brand || CAST(p_size AS VARCHAR) AS joined FROM part""")
def conversions(g: PropertyGraph) -> DataFrame:
    """toInteger, toFloat, toString and concatenation."""
    size, brand = F.col("p.size"), F.col("p.brand")
    return match(g, node("p", "Part")).select("p.id", scalars.to_integer(F.regexp_extract(brand, "[0-9]+", 0)).alias("number"), scalars.to_integer(F.col("p.title")).alias("no_number"), scalars.to_integer(F.col("p.retailprice"), "double").alias("whole"), scalars.to_float(F.concat(size.cast("string"), F.lit(".5"))).alias("half"), scalars.to_string(size).alias("text"), scalars.to_string(F.lit(None)).alias("nothing"), scalars.concat(brand, size).alias("joined"))


@query("""SELECT p_partkey AS id, trim(t) AS both_, ltrim(t) AS l, rtrim(t) AS r, starts_with(p_name, 'a') OR starts_with(p_name, 'P') AS starts,
round(len(list_intersect(list_distinct(x), list_distinct(y))) * 1.0 / len(list_distinct(list_concat(x, y))), 9) AS likeness
FROM (SELECT *, '  ' || p_name || ' ' AS t, string_split(p_type, ' ') AS x, string_split(p_brand || ' ' || p_type, ' ') AS y FROM part)""")
def more_text_functions(g: PropertyGraph) -> DataFrame:
    """trim, ltrim, rtrim, starts with any, and the likeness of token sets."""
    title, kind = F.col("p.title"), F.col("p.kind")
    t = F.concat(F.lit("  "), title, F.lit(" "))
    likeness = scalars.token_jaccard(kind, F.concat_ws(" ", "p.brand", "p.kind"))
    return match(g, node("p", "Part")).select("p.id", scalars.trim(t).alias("both_"), scalars.ltrim(t).alias("l"), scalars.rtrim(t).alias("r"), scalars.starts_with_any(title, ["a", "P"]).alias("starts"), F.round(likeness, 9).alias("likeness"))


@query("""SELECT p_partkey AS id, x[2] AS second, x[-1] AS final, x[9] AS beyond, array_to_string(x[2:3], '-') AS middle, array_to_string(x[1:len(x) - 1], '-') AS start_, len(list_filter(x, lambda w: len(w) > 5)) = 0 AS none_long,
len(list_filter(x, lambda w: w = x[1])) = 1 AS single, x[1] AS head_, '6,4,2' AS down FROM (SELECT p_partkey, string_split(p_type || ' ' || p_brand, ' ') AS x FROM part)""")
def more_list_functions(g: PropertyGraph) -> DataFrame:
    """Index, slice, none, single, head and a falling range."""
    x = scalars.split(F.concat_ws(" ", "p.kind", "p.brand"), " ")
    down = F.array_join(scalars.range_(F.lit(6), F.lit(1), -2), ",")
    return match(g, node("p", "Part")).select("p.id", scalars.at(x, 1).alias("second"), scalars.at(x, -1).alias("final"), scalars.at(x, 8).alias("beyond"), F.array_join(scalars.slice_(x, 1, 3), "-").alias("middle"), F.array_join(scalars.slice_(x, None, -1), "-").alias("start_"), scalars.none_of(x, lambda w: F.length(w) > 5).alias("none_long"), scalars.single(x, lambda w: w == x[0]).alias("single"), scalars.head(x).alias("head_"), down.alias("down"))


@query("""SELECT o_orderkey AS id, -p AS negative, p + 1 AS plus, p - 1 AS minus, p * 2 AS times, round(exp(k / 10.0), 9) AS e, pow(k, 2.0) AS squared, round(pi(), 12) AS pi_, round(p, 1) AS near, p IS NOT NULL AS there FROM (SELECT o_orderkey, o_totalprice AS p, o_orderkey % 10 AS k FROM orders)""")
def more_number_functions(g: PropertyGraph) -> DataFrame:
    p, k = F.col("o.totalprice"), F.col("o.id") % 10
    return match(g, node("o", "Order")).select("o.id", (-p).alias("negative"), (p + 1).alias("plus"), (p - 1).alias("minus"), (p * 2).alias("times"), F.round(F.exp(k / 10), 9).alias("e"), F.pow(k, F.lit(2.0)).alias("squared"), F.round(scalars.pi(), 12).alias("pi_"), scalars.round_(p, 1).alias("near"), p.isNotNull().alias("there"))


@query("""SELECT o_orderkey AS id, CAST(d AS VARCHAR) AS day, date_diff('day', d, DATE '2000-02-29') AS gap, CAST(CAST(d - 37 AS DATE) AS VARCHAR) AS earlier, d <= DATE '1996-12-31' AND d + 60 >= DATE '1996-01-01' AS during,
40 AS months_days, 1 AS left_days, month(d) AS m, quarter(d) AS q FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def durations(g: PropertyGraph) -> DataFrame:
    """datetime, between, sums and differences of durations, periods that overlap."""
    d = F.col("o.orderdate")
    day = lambda s: dates.date(F.lit(s))
    long = dates.plus(dates.duration(months=1), dates.duration(days=10))
    short = dates.minus(dates.duration(weeks=1, days=1), dates.duration(days=7))
    return match(g, node("o", "Order")).select(
        "o.id", dates.datetime(F.concat(d.cast("string"), F.lit("T10:00:00"))).cast("string").alias("day"), dates.between(d, day("2000-02-29"))["days"].cast("bigint").alias("gap"),
        dates.subtract(d, dates.duration(days=30, weeks=1)).cast("string").alias("earlier"), dates.valid_during(day("1996"), day("1996-12-31"), d, F.date_add(d, 60)).alias("during"),
        dates.days_of(long).alias("months_days"), dates.days_of(short).alias("left_days"), F.month(d).cast("bigint").alias("m"), F.quarter(d).cast("bigint").alias("q"),
    )


@query("""SELECT c_custkey AS id, s IN (1, 3) AS listed, NOT coalesce(s IN (1, 3), false) AS others, (b > 0) AND (s = 1) AS both_, (b > 0) OR (s = 1) AS either, b <> 0 AS differs FROM (SELECT c_custkey, c_nationkey AS s, c_acctbal AS b FROM customer)""")
def logic(g: PropertyGraph) -> DataFrame:
    from weftgraph.functions import predicates as p

    s, b = F.col("c.nationkey"), F.col("c.acctbal")
    return match(g, node("c", "Customer")).select("c.id", p.is_in(s, [1, 3]).alias("listed"), p.not_(s.isin(1, 3)).alias("others"), p.is_true((b > 0) & (s == 1)).alias("both_"), p.is_true((b > 0) | (s == 1)).alias("either"), p.ne(b, 0).alias("differs"))


# ---------------------------------------------------------------- series and places

_DAILY = "SELECT user_id AS id, CAST(ts AS DATE) AS d, ts, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)"


@query(f"""SELECT id, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM ({_DAILY}) WHERE d >= DATE '2024-01-02' GROUP BY 1""")
def series_statistics(g: PropertyGraph) -> DataFrame:
    s = g.series["User"]
    out = [series.aggregate(s, "value", how, "2024-01-02", None, name=name) for how, name in (("avg", "mean"), ("min", "low"), ("max", "high"), ("count", "n"))]
    m = out[0].join(out[1], "id").join(out[2], "id").join(out[3], "id")
    return m.select("id", F.round("mean", 6).alias("mean"), "low", "high", "n")


@query(f"""SELECT id, count(*) AS points, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, round(sum(value), 4) AS total FROM ({_DAILY}) GROUP BY 1""")
def series_points(g: PropertyGraph) -> DataFrame:
    points = F.col("series")
    total = F.aggregate(points, F.lit(0.0), lambda a, x: a + x["value"])
    return series.listed(g.series["User"], "value").select("id", F.size(points).cast("bigint").alias("points"), points[0]["date"].cast("string").alias("first_day"), F.element_at(points, -1)["date"].cast("string").alias("last_day"), F.round(total, 4).alias("total"))


_ORDERS = "SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders"


def _spending(g: PropertyGraph) -> DataFrame:
    """Customers' spending by month: the sum of a month at its first day."""
    s = series.collect(g.nodes["Order"].withColumn("day", F.col("orderdate")), "custkey", "day", {"spent": "totalprice"}, "month")
    return s.groupBy("id", "date", "channel").agg(F.sum("value").alias("value"))


@query(f"""WITH m AS (SELECT id, CAST(date_trunc('month', d) AS DATE) AS d, sum(v) AS v FROM ({_ORDERS}) GROUP BY 1, 2)
SELECT id, round(first(v ORDER BY d), 2) AS opening, round(last(v ORDER BY d), 2) AS closing FROM m WHERE d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def series_ends(g: PropertyGraph) -> DataFrame:
    s = _spending(g)
    a, b = (series.aggregate(s, "spent", how, "1995", "1997", name=n) for how, n in (("first", "opening"), ("last", "closing")))
    return a.join(b, "id").select("id", F.round("opening", 2).alias("opening"), F.round("closing", 2).alias("closing"))


@query(f"""WITH m AS (SELECT id, CAST(date_trunc('month', d) AS DATE) AS d, sum(v) AS v FROM ({_ORDERS}) GROUP BY 1, 2)
SELECT id, round(v, 2) AS value FROM m WHERE d = DATE '1996-05-01'""")
def series_at(g: PropertyGraph) -> DataFrame:
    return series.at(_spending(g), "spent", "1996-5").select("id", F.round("value", 2).alias("value"))


@query(f"""WITH m AS (SELECT id, CAST(date_trunc('month', d) AS DATE) AS d, sum(v) AS v FROM ({_ORDERS}) GROUP BY 1, 2), a AS (SELECT id, first(v ORDER BY d) AS v FROM m WHERE year(d) = 1995 GROUP BY 1), b AS (SELECT id, first(v ORDER BY d) AS v FROM m WHERE year(d) = 1996 GROUP BY 1)
SELECT id, round(b.v - a.v, 2) AS delta FROM a FULL JOIN b USING (id)""")
def series_delta(g: PropertyGraph) -> DataFrame:
    return series.delta(_spending(g), "spent", "1995", "1996").select("id", F.round("delta", 2).alias("delta"))


_POINTS = "SELECT c_custkey AS id, c_custkey * 37 % 120 - 60.0 AS lat, c_custkey * 53 % 340 - 170.0 AS lon FROM customer"


def _placed(g: PropertyGraph) -> PropertyGraph:
    n = g.nodes["Customer"].select("id", "title", (F.pmod(F.col("id") * 37, F.lit(120)) - 60.0).alias("lat"), (F.pmod(F.col("id") * 53, F.lit(340)) - 170.0).alias("lon"))
    return PropertyGraph(nodes={"Place": n}).set_spatial("Place", "lat", "lon")


@query(f"""SELECT CAST(min(lat) AS DOUBLE) AS south, CAST(min(lon) AS DOUBLE) AS west, CAST(max(lat) AS DOUBLE) AS north, CAST(max(lon) AS DOUBLE) AS east, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM ({_POINTS})""")
def bounds_and_centroid(g: PropertyGraph) -> DataFrame:
    s = traversal.select(_placed(g), "Place")
    return s.bounds().join(s.centroid().select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")))


@query(f"""SELECT id FROM ({_POINTS}) WHERE sqrt((lat - 10) * (lat - 10) + (lon - 20) * (lon - 20)) <= 15.01""")
def near_point_in_degrees(g: PropertyGraph) -> DataFrame:
    return traversal.select(_placed(g), "Place").near_point_degrees(10.0, 20.0, 15.01).ids()


@query(f"""SELECT id FROM ({_POINTS}) WHERE lat > -20 AND lat < 30 AND lon > 10 AND lon < 60""")
def points_in_a_shape(g: PropertyGraph) -> DataFrame:
    shape = F.lit("POLYGON ((10 -20, 60 -20, 60 30, 10 30, 10 -20))")
    n = _placed(g).nodes["Place"]
    return n.where(spatial.contains_point(shape, F.col("lat"), F.col("lon"))).select("id")


def _boxes(g: PropertyGraph) -> DataFrame:
    """Rectangles of half-integer corners, so that none touches another's border."""
    x, y = F.pmod(F.col("id") * 7, F.lit(50)).cast("double"), F.pmod(F.col("id") * 11, F.lit(40)).cast("double")
    w, h = F.pmod(F.col("id"), F.lit(9)) + 1.5, F.pmod(F.col("id"), F.lit(5)) + 1.5
    corner = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    ring = F.concat_ws(", ", corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))
    return g.nodes["Supplier"].select("id", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("shape"), (x + w / 2).alias("cx"), (y + h / 2).alias("cy"))


_BOXES = "SELECT s_suppkey AS id, s_suppkey * 7 % 50 AS x, s_suppkey * 11 % 40 AS y, s_suppkey % 9 + 1.5 AS w, s_suppkey % 5 + 1.5 AS h FROM supplier"


@query(f"""SELECT id, x < 30.25 AND x + w > 10.25 AND y < 30.25 AND y + h > 10.25 AS meets, x > 10.25 AND x + w < 30.25 AND y > 10.25 AND y + h < 30.25 AS within_, round(x + w / 2, 6) AS lon, round(y + h / 2, 6) AS lat, true AS valid FROM ({_BOXES})""")
def shapes(g: PropertyGraph) -> DataFrame:
    """intersects, contains, centroid and validity of shapes."""
    window = F.lit("POLYGON ((10.25 10.25, 30.25 10.25, 30.25 30.25, 10.25 30.25, 10.25 10.25))")
    b = _boxes(g).select("*", spatial.centroid(F.col("shape")).alias("c"))
    return b.select("id", spatial.intersects(window, F.col("shape")).alias("meets"), spatial.contains(window, F.col("shape")).alias("within_"), F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"), spatial.is_valid(F.col("shape")).alias("valid"))


# ---------------------------------------------------------------- fluent steps


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def fluent_orphans(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Supplier").where_orphans().ids()


@query("""SELECT c_custkey AS l0, count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def fluent_count(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Customer").traverse("PLACED", "out").count_by_parent()


@query("""SELECT c_custkey AS l0, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def fluent_unique_values(g: PropertyGraph) -> DataFrame:
    out = traversal.select(g, "Customer").traverse("PLACED", "out").unique_values("orderpriority")
    return out.select("l0", F.array_join("values", ",").alias("priorities"))


@query("""SELECT n_nationkey AS l0, string_agg(c_name, ', ' ORDER BY c_name) AS children FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal > 0) JOIN nation ON n_nationkey = c_nationkey WHERE r <= 3 GROUP BY 1""")
def fluent_chosen_children(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Nation").traverse("IN_NATION", "in", to="Customer")
    return s.collect_children("title", where={"acctbal": {">": 0}}, sort=[("acctbal", "desc")], limit=3)


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'gold' END AS tier FROM customer""")
def fluent_update(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Customer").where({"acctbal": {">": 9000}}).update({"tier": "gold"}).nodes["Customer"].select("id", "tier")


@query("""SELECT o_orderkey AS id, c_name AS buyer FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def fluent_add_properties(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer").traverse("PLACED", "out")
    return s.add_properties(0, {"buyer": "title"}).nodes["Order"].select("id", "buyer")


@query("""SELECT c_custkey AS id, n, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def fluent_aggregate_up(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer").traverse("PLACED", "out")
    return s.aggregate_up(0, {"n": "count(*)", "total": "sum(totalprice)"}).nodes["Customer"].select("id", "n", F.round("total", 2).alias("total"))


@query("""SELECT o_orderkey AS id, o_totalprice * 2 AS twice FROM orders""")
def fluent_store(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Order")
    return s.store(s.calculate("totalprice * 2", "twice"), "twice").nodes["Order"].select("id", "twice")


@query("""SELECT type, count(*) AS n FROM (SELECT 'Nation' AS type, '3' AS id UNION SELECT 'Region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION SELECT 'Customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3
UNION SELECT 'Supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3) GROUP BY 1""")
def fluent_expand(g: PropertyGraph) -> DataFrame:
    return traversal.select(g, "Nation").where({"id": 3}).expand(1).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT 'IN_NATION' AS edge_type, src_type, count(*) AS n FROM (SELECT 'Customer' AS src_type, c_custkey AS a, c_nationkey AS b FROM customer UNION SELECT 'Supplier', s_suppkey, s_nationkey FROM supplier) WHERE b < 5 GROUP BY 2""")
def fluent_connections(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Nation").where({"id": {"<": 5}})
    return s.connections("IN_NATION").groupBy("edge_type", "src_type").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS src, n_regionkey AS dst, n_name AS via FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def fluent_new_edges_with_properties(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Supplier").traverse("IN_NATION", "out").traverse("IN_REGION", "out")
    return s.create_connections("WORKS_IN", properties={"via": (1, "title")}).edges["WORKS_IN"][0].df.select("src", "dst", "via")


@query("""SELECT l_partkey AS src, c_custkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2""")
def fluent_new_edges_between_levels(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer").where({"mktsegment": "BUILDING"}).traverse("PLACED", "out").traverse("CONTAINS", "out")
    return s.create_connections("BOUGHT_BY", source=2, target=0).edges["BOUGHT_BY"][0].df.select("src", "dst")


@query("""SELECT DISTINCT l_orderkey AS l0, l_partkey AS l1 FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1995-12-31' AND CAST(l_shipdate AS DATE) + 30 >= DATE '1995-06-01'""")
def fluent_traverse_during(g: PropertyGraph) -> DataFrame:
    t = g.edges["CONTAINS"][0]
    df = t.df.withColumn("until", F.date_add("shipdate", 30))
    h = PropertyGraph(nodes=g.nodes, info=g.info).add_edges(df, "CONTAINS", "Order", "src", "Part", "dst", check=False).set_temporal("CONTAINS", "shipdate", "until")
    day = lambda s: dates.date(F.lit(s))
    return traversal.select(h, "Order").traverse("CONTAINS", "out", during=(day("1995-06-01"), day("1995-12-31"))).keys


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def fluent_union(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer")
    return s.where({"nationkey": {"<": 5}}).union(s.where({"acctbal": {"<": 0}})).ids()


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 AND c_acctbal < 0 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey >= 20 AND NOT c_acctbal < 0""")
def fluent_intersection_and_difference(g: PropertyGraph) -> DataFrame:
    s = traversal.select(g, "Customer")
    poor = s.where({"acctbal": {"<": 0}})
    return s.where({"nationkey": {"<": 5}}).intersection(poor).union(s.where({"nationkey": {">=": 20}}).difference(poor)).ids()


# ---------------------------------------------------------------- changes


@query("""SELECT 100000000 + row_number() OVER (ORDER BY n_name) AS k, n_name AS title FROM nation""")
def create_nodes(g: PropertyGraph) -> DataFrame:
    """Ids of new nodes go on after the largest; in order of their columns."""
    seed = g.nodes["Nation"].limit(1).select(F.lit(100_000_000).cast("bigint").alias("id"), F.lit("first").alias("title"))
    h = mutate.create_nodes(PropertyGraph(nodes={"Land": seed}), "Land", g.nodes["Nation"].select("title"), "title")
    return h.nodes["Land"].where("title <> 'first'").select(F.col("id").alias("k"), "title")


@query("""SELECT src, dst, count(*) AS n FROM (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 10) GROUP BY 1, 2""")
def create_edges(g: PropertyGraph) -> DataFrame:
    more = g.nodes["Nation"].where("id < 10").select(F.col("id").alias("src"), F.lit(0).alias("dst"))
    h = mutate.create_edges(g, "IN_REGION", "Nation", "Region", more)
    return h.edge_table("IN_REGION").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, count(*) AS n FROM (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation UNION SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 10) GROUP BY 1, 2""")
def merge_edges(g: PropertyGraph) -> DataFrame:
    more = g.nodes["Nation"].where("id < 10").select(F.col("id").alias("src"), F.lit(0).alias("dst"))
    h = mutate.merge_edges(g, "IN_REGION", "Nation", "Region", more)
    return h.edge_table("IN_REGION").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS mktsegment FROM customer""")
def remove_property(g: PropertyGraph) -> DataFrame:
    return mutate.remove_property(g, "Customer", "mktsegment", "nationkey = 3").nodes["Customer"].select("id", "mktsegment")


@query("""SELECT n_nationkey AS src, n_regionkey AS dst, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS deleted FROM nation WHERE n_regionkey <> 1""")
def delete_edges(g: PropertyGraph) -> DataFrame:
    gone = g.edge_table("IN_REGION").where("dst = 1")
    h = mutate.delete_edges(g, "IN_REGION", gone)
    return h.edge_table("IN_REGION").select("src", "dst", F.lit(h.reports[-1].counts["relationships_deleted"]).cast("bigint").alias("deleted"))


@query("""SELECT n_name AS title, CASE WHEN n_nationkey < 5 THEN 'known' END AS state FROM nation UNION ALL SELECT 'ATLANTIS', 'new'""")
def merge_on_match(g: PropertyGraph) -> DataFrame:
    n = g.nodes["Nation"]
    rows_ = n.where("id < 5").select("title").union(n.limit(1).select(F.lit("ATLANTIS").alias("title")))
    h = mutate.merge_nodes(PropertyGraph(nodes={"Nation": n.withColumn("state", F.lit(None).cast("string"))}), "Nation", rows_, ["title"], {"state": "new"}, {"state": "known"})
    return h.nodes["Nation"].select("title", "state")


def _upserted(g: PropertyGraph, mode: str) -> DataFrame:
    """Nations with a score, those under 10 loaded again: some with another, some with none, and one unknown nation."""
    old = g.nodes["Nation"].select("id", "title", F.when(F.col("id") % 2 == 0, F.col("id") * 10.0).alias("score"))
    new = g.nodes["Nation"].where("id < 10").select("id", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).alias("title"), F.when(F.col("id") % 3 != 1, F.col("id") + 0.5).alias("score"))
    new = new.union(new.limit(1).select(F.lit(100).alias("id"), F.lit("NEW").alias("title"), F.lit(7.0).alias("score")))
    return PropertyGraph().add_nodes(old, "N", "id", "title").add_nodes(new, "N", "id", "title", mode=mode).nodes["N"].select("id", "title", "score")


_UPSERT = """WITH o AS (SELECT n_nationkey AS id, n_name AS t, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10.0 END AS s FROM nation),
w AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '!' END AS t, CASE WHEN n_nationkey % 3 <> 1 THEN n_nationkey + 0.5 END AS s FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 100, 'NEW', 7.0)
SELECT id, {t} AS title, CAST({s} AS DOUBLE) AS score FROM (SELECT coalesce(o.id, w.id) AS id, o.id IS NOT NULL AS old, w.id IS NOT NULL AS new, o.t AS ot, w.t AS wt, o.s AS os, w.s AS ws FROM o FULL JOIN w ON o.id = w.id)"""


@query(_UPSERT.format(t="CASE WHEN new THEN wt ELSE ot END", s="CASE WHEN new THEN ws ELSE os END"))
def upsert_replace(g: PropertyGraph) -> DataFrame:
    return _upserted(g, "replace")


@query(_UPSERT.format(t="CASE WHEN old THEN ot ELSE wt END", s="CASE WHEN old THEN os ELSE ws END"))
def upsert_skip(g: PropertyGraph) -> DataFrame:
    return _upserted(g, "skip")


@query(_UPSERT.format(t="coalesce(ot, wt)", s="coalesce(os, ws)"))
def upsert_preserve(g: PropertyGraph) -> DataFrame:
    return _upserted(g, "preserve")


@query("""SELECT l_suppkey AS src, l_partkey AS dst, 2 * count(*) AS quantity FROM lineitem GROUP BY 1, 2""")
def upsert_sum(g: PropertyGraph) -> DataFrame:
    """Relationships loaded twice: their numbers add up. Half a million lines go to a task, however many there are."""
    lines = g.edges["SUPPLIED"][0].df
    t = lines.repartition(1 + lines.count() // 500_000, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("quantity"))
    h = PropertyGraph(nodes=g.nodes).add_edges(t, "SOLD", "Supplier", "src", "Part", "dst", check=False).add_edges(t, "SOLD", "Supplier", "src", "Part", "dst", mode="sum", check=False)
    return h.edges["SOLD"][0].df.select("src", "dst", "quantity")


# ---------------------------------------------------------------- rules and inspection


def _next(g: PropertyGraph) -> PropertyGraph:
    """Suppliers that lead to others by made-up rules: to themselves, back and forth, and on."""
    n = g.nodes["Supplier"].select("id")
    k = n.count()
    steps = n.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 7 % k, F.col("id") * 3 % k)).alias("dst")).where(f"dst between 1 and {k}")
    back = n.select((F.col("id") * 7 % k).alias("src"), F.col("id").alias("dst")).where(f"dst % 2 = 0 and src between 1 and {k}")
    h = PropertyGraph(nodes={"Supplier": g.nodes["Supplier"]}, info=g.info)
    return h.add_edges(steps, "LEADS", "Supplier", "src", "Supplier", "dst", check=False).add_edges(back, "RETURNS", "Supplier", "src", "Supplier", "dst", check=False)


_LEADS = """k AS (SELECT count(*) AS k FROM supplier), e AS (SELECT s_suppkey AS s, s_suppkey * 7 % k AS d FROM supplier, k UNION SELECT s_suppkey, s_suppkey * 3 % k FROM supplier, k), l AS (SELECT s, d FROM e, k WHERE d BETWEEN 1 AND k),
b AS (SELECT s_suppkey * 7 % k AS s, s_suppkey AS d FROM supplier, k WHERE s_suppkey % 2 = 0 AND s_suppkey * 7 % k BETWEEN 1 AND k)"""


@query(f"WITH {_LEADS} SELECT DISTINCT s AS id FROM l WHERE s = d AND s IN (SELECT s_suppkey FROM supplier)")
def rule_self_loops(g: PropertyGraph) -> DataFrame:
    return integrity.self_loops(_next(g), "Supplier", "LEADS").select("id")


@query(f"WITH {_LEADS} SELECT DISTINCT s AS src, d AS dst FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = l.d AND b.d = l.s)")
def rule_inverse(g: PropertyGraph) -> DataFrame:
    return integrity.inverse_violations(_next(g), "LEADS", "RETURNS")


@query(f"""WITH {_LEADS}, u AS (SELECT DISTINCT s, d FROM l) SELECT x.s AS a, x.d AS b, y.d AS c FROM u x JOIN u y ON y.s = x.d WHERE x.s <> y.d AND x.s <> x.d AND x.d <> y.d AND NOT EXISTS (SELECT 1 FROM u z WHERE z.s = x.s AND z.d = y.d)""")
def rule_transitivity(g: PropertyGraph) -> DataFrame:
    return integrity.transitivity_violations(_next(g), "LEADS")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def rule_missing_inbound_edge(g: PropertyGraph) -> DataFrame:
    t = g.edges["CONTAINS"][0]
    h = PropertyGraph(nodes=g.nodes).add_edges(t.df.where("quantity > 45"), "BULK", "Order", "src", "Part", "dst", check=False)
    return integrity.missing_inbound_edge(h, "Part", "BULK").select("id")


@query("SELECT src_type, count(*) AS n FROM (SELECT 'Customer' AS src_type FROM customer UNION ALL SELECT 'Supplier' FROM supplier) GROUP BY 1")
def rule_range(g: PropertyGraph) -> DataFrame:
    return integrity.type_range_violations(g, "IN_NATION", "Region").groupBy("src_type").agg(F.count("*").alias("n"))


@query("""SELECT 'Event' AS type, 'required' AS rule, 'value' AS field, count(*) AS violations FROM events WHERE value IS NULL HAVING count(*) > 0""")
def schema_validation(g: PropertyGraph) -> DataFrame:
    from dataclasses import replace

    return integrity.validate(replace(g, schema={"Event": {"required": ["event_type", "value"], "types": {"value": "double"}}})).withColumn("violations", F.col("violations").cast("bigint"))


@query("""SELECT 'IN_REGION' AS edge_type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem
UNION ALL SELECT 'SUPPLIED', count(*) FROM lineitem UNION ALL SELECT 'FILLED_BY', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events""")
def edge_type_counts(g: PropertyGraph) -> DataFrame:
    return inspect.edge_type_counts(g)


@query("""SELECT 'Nation' AS src_type, 'IN_REGION' AS edge_type, 'Region' AS dst_type, count(*) AS n FROM nation UNION ALL SELECT 'Customer', 'IN_NATION', 'Nation', count(*) FROM customer UNION ALL SELECT 'Supplier', 'IN_NATION', 'Nation', count(*) FROM supplier""")
def neighbours_of_a_type(g: PropertyGraph) -> DataFrame:
    return inspect.neighbors_schema(g, "Nation")


@query("""SELECT c_custkey AS id, c_name AS title FROM customer ORDER BY c_custkey LIMIT 5""")
def sample_of_a_type(g: PropertyGraph) -> DataFrame:
    return inspect.sample(g, "Customer").select("id", "title")


@query("""SELECT 'Nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, n_name AS title FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)""")
def search_by_title(g: PropertyGraph) -> DataFrame:
    first = g.nodes["Nation"].agg(F.min("title")).first()[0]
    return inspect.search(g, first).withColumn("id", F.col("id").cast("string"))


# ---------------------------------------------------------------- paths


@query("""SELECT c_custkey AS customer, count(DISTINCT l_suppkey) AS suppliers, CAST(3 AS BIGINT) AS nodes FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def two_hop_paths(g: PropertyGraph) -> DataFrame:
    """A path variable: the nodes that it goes through."""
    m = match(g, node("c", "Customer").out("PLACED", "o", "Order").out("FILLED_BY", "s", "Supplier"))
    m = m.withColumn("p", F.array(*[F.concat_ws(":", f"{v}.type", F.col(f"{v}.id").cast("string")) for v in ("c", "o", "s")]))
    return m.groupBy(F.col("c.id").alias("customer")).agg(F.count_distinct("s.id").alias("suppliers"), F.max(F.size("p")).cast("bigint").alias("nodes"))


@query("""SELECT a.c_custkey AS source, b.o_orderkey AS target, true AS linked FROM customer a JOIN orders b ON b.o_custkey = a.c_custkey WHERE a.c_custkey % 50 = 0""")
def linked_pairs(g: PropertyGraph) -> DataFrame:
    """Whether a customer is connected with its own orders and with those of the next one."""
    from weftgraph.operators import algorithms

    e = g.edge_table("PLACED").select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    nodes = g.nodes["Customer"].select((F.col("id") * 2).alias("id")).union(g.nodes["Order"].select((F.col("id") * 2 + 1).alias("id")))
    comps = algorithms.connected_components(nodes, e)
    pairs = e.select(F.explode(F.array(F.col("src"), F.col("src") + 2)).alias("source"), F.col("dst").alias("target")).where("source % 100 = 0")
    out = paths.connected(e, pairs, comps).where("connected")
    return out.select((F.col("source") / 2).cast("bigint").alias("source"), ((F.col("target") - 1) / 2).cast("bigint").alias("target"), F.col("connected").alias("linked"))


@query("""SELECT o_orderpriority AS priority, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY mean DESC NULLS LAST, priority LIMIT 3""")
def grouped_top(g: PropertyGraph) -> DataFrame:
    m = match(g, node("o", "Order", orderstatus={"!=": "P"})).groupBy(F.col("o.orderpriority").alias("priority")).agg(F.round(F.avg("o.totalprice"), 4).alias("mean"))
    return rows.top(m, 3, ("mean", "desc"), "priority")
