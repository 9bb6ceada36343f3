"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from wavelode import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ == "NAType":
            return None
        kind = type(v).__name__
        return bool(v) if "bool" in kind else int(v) if "int" in kind else round(float(v), 9) + 0.0 if "float" in kind else v

    df = df[sorted(df.columns)]
    found = [tuple(map(plain, r)) for r in df.itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    expected = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
