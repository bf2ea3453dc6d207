import __spark_entry__ as entry
from weftgraph import queries


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["segment", "n", "total"]


def test_a_query_agrees_with_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("two_hops", "optional", "windows"):
        got = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in queries.QUERIES[name](spark, d).collect())
        df = con.execute(queries.SQL[name]).df()
        assert got == sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False)))
