"""Every registered core query against DuckDB on the smallest tables."""

import duckdb
import pytest

from tracemill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toArrow()
    if name not in catalog.oracle_sql():
        assert got.num_rows
        return
    want = duck.execute(catalog.oracle_sql()[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert cols == sorted(got.column_names)
    assert [str(want.schema.field(c).type) for c in cols] == [str(got.schema.field(c).type) for c in cols]
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in cols])))
    assert rows(want) == rows(got)


def test_every_vector_is_exploded(spark):
    want = spark.read.parquet(f"{DIR}/embeddings.parquet").selectExpr("sum(size(embedding)) AS n", "count(*) AS rows").first()
    assert want.rows > 20 and catalog.queries()["explode_array"](spark, DIR).count() == want.n


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
