"""Every query against its SQL on the small driver tables."""

import os

import duckdb
import pytest

import geostream.file_queries  # noqa: F401  adds to the queries
import geostream.more_queries  # noqa: F401  adds to the queries
import geostream.state_queries  # noqa: F401  adds to the queries
from geostream.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(df):
    columns = sorted(df.columns)
    own = df[columns].map(lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v)
    return columns, sorted(map(tuple, own.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, DATA).toPandas()) == _rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_yields_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
