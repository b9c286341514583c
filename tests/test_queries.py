import math

import duckdb
import pytest

import __spark_entry__
from tabwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(rows):
    plain = [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    got = _sorted(tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect())
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == names
    assert got == _sorted(want.select(*[f'"{n}"' for n in names]).fetchall())
