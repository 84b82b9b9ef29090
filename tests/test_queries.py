"""Every registered query against its SQL, and the driver's contract."""

import duckdb
import pytest

from strandforge import file_queries  # noqa: F401  (registers its queries)
from strandforge.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def show(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(con.sql(ORACLES[name]).columns) == cols
    want = con.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(tuple(map(show, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(show, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_conservation_tests_every_locus_with_a_telling_null(spark, sf):
    got = QUERIES["altframe_conservation"](spark, sf).select("p_value").collect()
    assert len(got) > 10
    assert min(r.p_value for r in got if r.p_value is not None) < 0.01
